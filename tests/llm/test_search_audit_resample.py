"""Nearest neighbours, the filter audit and resampling against brute force, and on nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, audit, resample

CLASH = ("rank", "score", "h", "part", "mask", "ids", "n_words", "weight", "lists", "list", "block", "size", "digest", "good")


def clashing(df):
    return df.withColumns({n: F.lit("clash") for n in CLASH if n not in df.columns})


def plain_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def test_crcs_of_runs_come_from_prefixes():
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "Bc", "é", "日本", " ", "  ", "-", "\n", "7"]) for _ in range(r.randint(0, 40))).encode() for _ in range(60)] + [b"", b"x" * 70_000 + b" y"]
    for longest in (1, 3):
        crcs, counts, words = resample.feature_crcs(texts, longest)
        ends = np.append(0, np.cumsum(counts))
        for k, text in enumerate(texts):
            own = plain_words(text.decode())
            assert words[k] == len(own)
            assert Counter(crcs[ends[k] : ends[k + 1]].tolist()) == Counter(zlib.crc32(b" ".join(own[i : i + n])) for n in range(1, longest + 1) for i in range(len(own) - n + 1))


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 97), (1, 70_000)])
def test_resampling_equals_plain_python(spark, longest, buckets):
    r = random.Random(5)
    vocabulary = ["red", "Blue", "grün", "sea", "42", "it's", "far-off", "日"]
    texts = [None, "", "...", *(" ".join(r.choice(vocabulary[: 3 + k % 6]) for _ in range(r.randint(15, 60))) for k in range(120))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, texts[8])]
    aims = ["red sea " * 5, "sea sea blue", None, ""]
    got = resample.resample(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), clashing(spark.createDataFrame([(k, t) for k, t in enumerate(aims)], "item_id long, text string")), longest=longest, buckets=buckets).collect()

    def ids(text):
        own = plain_words(text)
        return [zlib.crc32(b" ".join(own[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    source, target = Counter(x for _, t in rows for x in ids(t)), Counter(x for t in aims for x in ids(t))
    s, t = sum(source.values()), sum(target.values())
    expected = []
    for doc, text in rows:
        weight = sum(math.floor(1000 * math.log((target[x] + 1.0) * (s + buckets) / ((source[x] + 1.0) * (t + buckets)))) for x in ids(text))
        h = None if doc is None else int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        expected.append([doc, len(ids(text)), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    fit = sorted((x for x in expected if x[5] >= 20 and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(fit[: 10 * len(fit) // 100]):
        x[4] = k + 1
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(x[:5]) for x in expected), key=repr)
    assert len(fit) > 90 and sum(x[4] is not None for x in expected) == len(fit) // 10


def test_resampling_of_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    one = resample.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), none).collect()
    assert [(r.n_features, r.rank) for r in one] == [(30, None)]
    all_ = resample.resample(spark.createDataFrame([(k % 5, "a " * 30) for k in range(40)], "doc_id long, text string").repartition(4), none, percent=100).collect()
    assert sorted(r.rank for r in all_) == list(range(1, 41)) and [r.doc_id for r in sorted(all_, key=lambda r: r.rank)] == sorted((r.doc_id for r in all_), key=lambda d: [-next(r.score for r in all_ if r.doc_id == d), d])


def brute_audit(rows, labels):
    firsts = {}
    for doc, _, text in rows:
        if doc is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc), doc)
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for doc, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc is not None and doc > firsts[text])
        fails.append((lang or "", own, doc in good, doc in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order):
                before = set(order[:step])
                removed = [f for f in own if x in f[1] and not before & set(f[1])]
                shapley[x] += len(removed)
                out[part, order, step + 1] = [sum(not set(order[: step + 1]) & set(f[1]) for f in own), len(removed), sum(x in f[1] and bool(before & set(f[1])) for f in own), sum(f[1] == x for f in own), sum(f[2] for f in removed), sum(f[3] for f in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("counters", [None, 512])
def test_audit_equals_brute_force(spark, monkeypatch, counters):
    if counters:  # one block for all: the sketch clears nothing, and the result is the same
        monkeypatch.setattr(audit, "LEAST_COUNTERS", counters)
        monkeypatch.setattr(audit, "MOST_COUNTERS", counters)
        monkeypatch.setattr(audit, "HELD", 50)
    r = random.Random(6)
    texts = [None, "", " ", "A B", "#", *(" ".join(r.choice(["a", "B", "c#", "dé", *map(str, range(k % 140))]) for _ in range(r.randint(60, 160))) for k in range(60))]
    rows = [(k, r.choice(["en", "de", None, ""]), r.choice(texts)) for k in range(150)]
    rows += [(3, "en", rows[3][2]), (9, "en", "another text of id 9"), (8, "de", "another text of id 9"), (None, "en", rows[5][2]), (None, None, None)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 150, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (9, None, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = audit.audit(docs.withColumns({n: F.lit("clash") for n in ("part", "mask", "h", "digest", "n", "good", "block")}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert got.columns == names
    found = got.collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == brute_audit(rows, labels)


def test_sketch_clears_unique_texts_and_keeps_all_repeats(spark):
    rows = spark.range(30_000).select("id", F.xxhash64(F.when(F.col("id") < 10_000, F.col("id") % 10).otherwise(F.col("id"))).alias("h")).repartition(7)
    kept = {r.id for r in audit.possible_repeats(rows, audit._counters(30_000)).select("id").collect()}
    assert set(range(10_000)) <= kept and len(kept) < 10_000 + 0.05 * 20_000
    assert audit._counters(10**10) == audit.MOST_COUNTERS


def test_audit_of_no_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    assert audit.audit(spark.createDataFrame([(1, "en", "x")], docs.schema), labels).count() == 600


def brute_nearest(rows, asks, k):
    out = {}
    for a, q in asks:
        scored = {(sum_in_order(q, v), i) for i, v in rows if i != a and len(v) == len(q)}
        out[a] = sorted(((-s, i) for s, i in scored if not math.isnan(s)))[:k]
    return {a: [(i, -s) for s, i in best] for a, best in out.items()}


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def found_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {a: [(i, s) for _, i, s in sorted(v)] for a, v in got.items()}


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_nearest_finds_nine_of_ten(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "KEPT", 500)
    random_ = np.random.default_rng(8)
    if kind == "clusters":
        points = random_.normal(size=(40, 16))[random_.integers(0, 40, 2500)] + 0.15 * random_.normal(size=(2500, 16))
    else:
        points = random_.normal(size=(2500, 16))
        points *= 1 if kind == "sphere" else np.exp(random_.normal(size=(2500, 1)))
    rows = list(enumerate(points.tolist()))
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    asks = [x for x in rows if x[0] % 20 == 0]
    got, true = found_of(ann.nearest(df, df.where("vec_id % 20 = 0"), 20, block=64)), brute_nearest(rows, asks, 20)
    assert set(got) == {a for a, _ in asks} and np.mean([len(set(got[a]) & set(true[a])) / 20 for a in got]) >= 0.9
    assert all(len(v) == 20 and v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_clear_clusters_are_searched_alone():
    random_ = np.random.default_rng(9)
    points = ann.as_directions(random_.normal(size=(60, 24))[random_.integers(0, 60, 6000)] + 0.1 * random_.normal(size=(6000, 24)))
    graph = ann.CentroidGraph.of(ann.fit_centroids(points, 39))
    lists = ann.postings(graph, points)
    asked = np.arange(0, 6000, 60)
    near = np.argsort(-(points[asked] @ points.T), axis=1)[:, :20]
    ratio = ann.measured_ratio(graph, points[asked], [(q, lists[x]) for q, row in enumerate(near) for x in row])
    sizes = np.bincount(np.concatenate(lists), minlength=39)
    searched = ann.within(graph, points[asked], ratio)
    assert np.mean([sizes[w].sum() for w in searched]) < 0.2 * 6000 and np.mean([bool(set(lists[x]) & set(w.tolist())) for row, w in zip(near, searched) for x in row]) >= 0.95
    # a vector near a boundary is in several lists; all lists can be reached over the graph
    assert 1 < np.mean([len(x) for x in lists]) < 4 and np.array_equal(np.sort(graph.search(points[:5], 39)[0], axis=1), np.tile(np.arange(39), (5, 1)))


def test_lists_come_out_balanced():
    random_ = np.random.default_rng(10)
    points = ann.as_directions(np.concatenate([random_.normal(size=(4000, 8)), [5, 0, 0, 0, 0, 0, 0, 0] + random_.normal(size=(2000, 8))]))
    sizes = np.bincount([x[0] for x in ann.postings(ann.CentroidGraph.of(ann.fit_centroids(points, 40)), points)], minlength=40)
    assert sizes.max() < 3 * sizes.mean()


def test_nearest_on_odd_rows(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(90)]  # many equal vectors and ties
    rows += [(200, None), (201, [1.0, None, 1.0]), (202, [0.0, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (None, [9.0, 9.0, 9.0])]
    rows += [(0, [50.0, 1.0, 1.0]), (5, [5.0, 1.0, 2.0]), (300, [1.0, 2.0]), (320, [2.0, 1.0]), (340, [1e300, -1e300, 1e300]), (341, [1e300, 1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in real:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    got = found_of(ann.nearest(df, df.where("vec_id % 20 = 0"), 20, recall=1.0))
    assert got == {a: v for a, v in brute_nearest(real, asks.items(), 20).items() if v}
    assert ann.nearest(df.where("vec_id < 0"), df, 5).count() == 0 and ann.nearest(df, df.where("vec_id < 0"), 5).count() == 0
    assert found_of(ann.nearest(df.where("vec_id = 1"), df.where("vec_id = 1"), 5)) == {}
    floats = df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id < 90")
    assert len(found_of(ann.nearest(floats, floats.where("vec_id = 40"), 200, recall=1.0))[40]) >= 89
