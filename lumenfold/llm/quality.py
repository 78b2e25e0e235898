"""Quality classifier: a sparse ensemble of rules over statistics of the text.

The paths of a small random forest become conjunctive rules over the statistics; a lasso logistic regression
weighs them, which sets most to zero; the rest are compiled into one Spark column, so that scoring is a map in the
JVM. Both fits are of Spark's own library, on labelled documents chosen by a hash of their id, `TRAIN_ROWS` at most
whatever the size of the corpus. Labels, language, source and id are never inputs of a score.

Nulls and edge cases: a null text counts as empty and has a score like any other; labels other than 0 and 1, null ones and those of
null ids are left out, and of several labels for one document the smallest counts; of rows with the same labelled id one is
learned from, that whose text has the smallest MD5, so that the bound holds for rows; without labels of both kinds the score is
the share of label 1 (0.5 without any); texts are taken whole; repeated rows get the same score each; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint

TRAIN_ROWS, TREES, DEPTH, PENALTY = 20_000, 12, 3, 0.001


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def column(self, stats: Callable[[str], Column]) -> Column:
        return stats(self.stat) > self.threshold if self.above else stats(self.stat) <= self.threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights, and the intercept."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self, text: Column) -> Column:
        """The probability of label 1. The statistics are bound once, whatever the optimizer moves around."""

        def weigh(stats: Column) -> Column:
            total = F.lit(self.intercept)
            for rule, weight in self.rules:
                total = total + F.when(holds(rule, lambda name: stats[name]), weight).otherwise(0.0)
            return 1.0 / (1.0 + F.exp(-total))

        return F.element_at(F.transform(F.array(statistics(text)), weigh), 1)


def statistics(text: Column) -> Column:
    """A struct of numbers about a text; none depends on its language's words."""
    text = F.coalesce(text, F.lit(""))
    chars, words = F.greatest(F.lit(1), F.length(text)), F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")))

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return F.struct(
        F.log1p(words.cast("double")).alias("log_words"),
        (chars / words).alias("chars_per_word"),
        (F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))) / words).alias("distinct_words"),
        share(r"[#*$%&|<>]").alias("symbols"),
        share(r"[!?]").alias("shouts"),
        share(r"\p{Lu}").alias("capitals"),
        share(r"[0-9]").alias("digits"),
        share(r"[.,]").alias("stops"),
        share(r"\n").alias("lines"),
    )


STATS = ("log_words", "chars_per_word", "distinct_words", "symbols", "shouts", "capitals", "digits", "stops", "lines")


def holds(rule: tuple[Condition, ...], stats: Callable[[str], Column]) -> Column:
    out = rule[0].column(stats)
    for condition in rule[1:]:
        out = out & condition.column(stats)
    return out


def tree_rules(description: str) -> list[tuple[Condition, ...]]:
    """The conjunction of each path from a root to any node below it, from Spark's description of a forest."""
    found: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, Condition(STATS[int(m[2])], m[3] == ">", float(m[4]))))
            found[tuple(sorted((c for _, c in path), key=lambda c: (c.stat, c.above, c.threshold)))] = None
        elif "Tree" in line:
            path = []
    return list(found)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """The ensemble, from `train_rows` labelled documents at most. Only these are broadcast, joined and counted."""
    own = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("double").alias("label")).where("label_id is not null and label in (0, 1)")
    own = own.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    rows = docs.select(docs[id_col].cast("long").alias("label_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "label_id")
    rows = rows.select("label_id", "label", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own"), statistics(F.col("text")).alias("stats"))
    rows = shared_checkpoint(rows.groupBy("label_id", "label").agg(F.min_by("stats", "own").alias("stats")))
    rows = rows.orderBy("label_id").coalesce(1)  # train_rows at most
    counted = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones = counted.get(1.0, 0)
    if len(counted) < 2:
        share = (ones + 1) / (sum(counted.values()) + 2)
        return RuleEnsemble((), math.log(share / (1 - share)))
    vectors = rows.select("label", "stats", array_to_vector(F.array(*(F.col(f"stats.{s}") for s in STATS))).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", subsamplingRate=0.7, featureSubsetStrategy="0.6", minInstancesPerNode=5).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    held = rows.select("label", array_to_vector(F.array(*(holds(r, lambda name: F.col(f"stats.{name}")).cast("double") for r in rules))).alias("rules"))
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(tuple((r, w) for r, w in zip(rules, weights) if w), float(lasso.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = fit(docs, labels, id_col, text_col).score(docs[text_col])
    scored = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score 0.5 or more."""
    return docs.where(fit(docs, labels, id_col, text_col).score(docs[text_col]) >= 0.5)
