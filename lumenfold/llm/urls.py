"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path follows up to
`?`, `#` or the end. A rule has a host and a path: it fits that host and its subdomains if the path begins with its own;
of those that fit, the longest wins. Other urls are judged by the model, which is trained from a small table of
labelled urls (`labelled`, or one that is given). Features and model are of Spark's own library; no shuffle.

Nulls and edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed if the
model has no reason against it; long urls are taken whole; repeated rows get the same verdict each; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import string
import zlib
from random import Random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, LENGTHS = 1 << 16, (3, 4, 5)
#: Rows of the labelled table of each type of page.
PER_SHAPE = 160

# Words that show what a site is for, and words that sites of any kind have in their names.
BLOCKED_WORDS = (
    "casino slots poker jackpot roulette betting bets porn adult xxx sexcams escort nude pills viagra pharma dietpills meds spam linkfarm seofarm ads adtracker adserver adclick "
    "tracker popunder bannerads payday loans fastcash cryptodouble freeiphone prizeclaim warez cracked torrent replica phish malware keygen lottery winbig cheapmeds"
).split()
ALLOWED_WORDS = (
    "library museum history science weather garden recipes travel health school college university physics biology chemistry algebra "
    "poetry novels stories letters journal gazette herald tribune dailypost news star council parliament court archive records census "
    "atlas rivers mountains forest ocean harbour railway airport theatre orchestra gallery painting sculpture film radio chess football cycling "
    "hiking cooking bakery farming horses birds insects flowers trees astronomy geology medicine nursing dentist pharmacy lawyers engineers software "
    "manual handbook tutorial forum questions answers wiki dictionary grammar translation language lessons exams students teachers parents children"
).split()
COMMON_WORDS = "best my the online hub zone club top live city today world central direct plus first one home point house".split()


SYLLABLES = "ba be bo ca co da de di do fa fi ga go ha he in ka ke la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti to va ve wa".split()
#: Shapes of urls by the type of their page, for names that say nothing: addresses that only pass a visitor on, farms of links, hosts made by
#: number and files that wait for a click; and articles, manuals, shops, forums and pages by language. {a} to {d} are names, {n} and {m} numbers.
BLOCKED_SHAPES = {
    "redirect": ("http://{a}{n}.{b}.{t}/go/{h}/{n}", "https://r.{a}{b}.{t}/click.php", "http://{a}.{b}{m}.{t}/out/{h}/r.php", "https://trk.{a}.{t}/c/{h}/{m}/{n}"),
    "farm": ("http://{a}-{b}-{c}-{d}.{t}/{b}-{c}-{d}-{a}-{n}.html", "http://{a}-{b}-{c}.{t}/{c}-{b}-{m}-{n}.htm", "https://www.{a}-{b}-{c}-{d}.{t}/"),
    "numbers": ("http://{a}{n}{b}{m}.{t}/{m}/{n}/index{m}.php", "http://{n}{a}{m}.{t}/{n}.php", "https://x{n}{a}{m}.{t}/{m}{n}/"),
    "trap": ("http://{a}{b}.{t}/{c}/setup_v{n}.exe", "http://dl{m}.{a}.{t}/{b}_{n}_full.zip", "https://get.{a}{n}.{t}/{b}.apk"),
    "offer": ("https://{a}-{b}{n}.{t}/lp/{m}/?", "http://{a}{n}.{b}.{t}/promo{m}/win/{h}", "https://{a}.{t}/offer/{h}/claim{n}.php"),
}
ALLOWED_SHAPES = {
    "article": ("https://www.{a}{b}.{u}/20{m}/0{k}/{c}-{d}-{a}", "https://{a}.{u}/news/{c}-{d}.html", "https://blog.{a}.{u}/{b}-{c}/"),
    "manual": ("https://docs.{a}.{u}/{b}/{c}.html", "https://{a}{b}.{u}/docs/{c}/{d}", "https://wiki.{a}.{u}/wiki/{c}_{d}"),
    "shop": ("https://www.{a}.{u}/products/{b}-{c}", "https://shop.{a}{b}.{u}/category/{c}/{d}/", "https://{a}.{u}/item/{n}"),
    "forum": ("https://forum.{a}.{u}/thread/{n}", "https://www.{a}{b}.{u}/users/{c}/posts/{n}", "https://{a}.{u}/questions/{n}/{b}-{c}-{d}"),
    "language": ("https://www.{a}{b}.{u}/{l}/{n}", "http://m.{a}.example.{u}/{l}/{n}.html", "https://{a}{b}.example.{u}/{l}/{n}/", "http://{a}-{b}.{u}/{l}/{n}"),
}
BLOCKED_ENDINGS, ALLOWED_ENDINGS = "xyz top click buzz win loan info com net".split(), "com org net info edu io co.uk de fr".split()


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, label, kind, held_out), label 1 for urls to block.

    Rows of kind `words` have a telling word in the site's name, mostly with a common one before or after it, and stand in urls of several
    shapes. The others are of a type of page (`BLOCKED_SHAPES`, `ALLOWED_SHAPES`), with names of syllables that tell nothing, so that
    host and path must do. `held_out` marks a fifth of the names of `words`, and a fifth of the rows of the others, for measuring.
    """
    rows = []
    for label, words in ((1.0, BLOCKED_WORDS), (0.0, ALLOWED_WORDS)):
        for k, word in enumerate(words):
            for j in range(6):
                other = COMMON_WORDS[(7 * k + 3 * j) % len(COMMON_WORDS)]
                name = (word, f"{word}-{other}", f"{other}-{word}", f"{word}{other}", f"{other}{word}", f"{other}-{word}-{COMMON_WORDS[(k + j) % 20]}")[j]
                language, ending, number = ("en", "fr", "de", "es")[(k + j) % 4], ("com", "org", "net", "info")[(k + 2 * j) % 4], 7 + 137 * k + 31 * j
                shapes = (
                    f"https://www.{name}.{ending}/{language}/{number}",
                    f"http://{name}.{ending}/{language}/{number}.html",
                    f"https://blog.{name}.{ending}/",
                    f"https://m.{name}.example.{ending}/{language}/{number}/?ref={number % 9}",
                    f"http://www.{ending}-portal.org/{language}/{name}/{number}",
                )
                rows += [(url, label, "words", zlib.crc32(name.encode()) % 5 == 0) for url in (shapes[j % 5], shapes[(j + 2) % 5], shapes[(j + 3) % 5])]
    r = Random(5)

    def name() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))

    for label, shapes in ((1.0, BLOCKED_SHAPES), (0.0, ALLOWED_SHAPES)):
        for kind, forms in shapes.items():
            for _ in range(PER_SHAPE):
                parts = {x: name() for x in "abcd"} | {"n": r.randint(2, 99_999), "m": r.randint(10, 29), "k": r.randint(1, 9), "h": f"{r.getrandbits(40):x}", "l": r.choice(("en", "fr", "de", "es", "ja"))}
                url = r.choice(forms).format(t=r.choice(BLOCKED_ENDINGS), u=r.choice(ALLOWED_ENDINGS), **parts)
                rows.append((url, label, kind, zlib.crc32(url.encode()) % 5 == 0))
    return spark.createDataFrame(rows, "url string, label double, kind string, held_out boolean").coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, parts, 2)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The rule (like `net/es/`) that wins, or null, and its verdict. `rules` maps each rule to allow or block."""
    rule = verdict = None
    for text in sorted(rules, key=lambda r: (len(r), r), reverse=True):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, rules[text]) if verdict is None else verdict.when(fits, rules[text])
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, marked by which they come from."""

    def of(text: Column, mark: str) -> Column:
        def every(letters: Column) -> Column:
            def long(n: int) -> Column:
                return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(letters) - n + 1)), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, n), "")))

            return F.concat(*map(long, LENGTHS))

        # bound in a lambda, so that a text is split once and not for every gram
        return F.element_at(F.transform(F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), "")), every), 1)

    return F.concat(of(host, "h"), of(path, "p"))


def _features(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(urls.withColumn("grams", grams(F.col("host"), F.col("path"))))


def train(examples: DataFrame) -> LogisticRegressionModel:
    """The model from (url, label)."""
    host, path = host_and_path(F.col("url"))
    rows = _features(examples.select("label", host.alias("host"), path.alias("path")))
    return LogisticRegression(regParam=0.001, standardization=False, maxIter=50).fit(rows)


def judge(pages: DataFrame, rules: dict[str, str], examples: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and the model's probability of block as `score`."""
    model = train(labelled(pages.sparkSession) if examples is None else examples)
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    scored = model.transform(_features(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
