"""Folding albums that are almost the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import album_priority, jaccard

#: Steps of a hash by which members are put in order.
STEPS = 1024


def _turn(kind: Column, n: Column, draft: Column) -> Column:
    """Which of two drafts survives: the earlier kind, then the larger one, then the smaller name."""
    return F.struct(album_priority(kind).alias("rank"), (-n).alias("less"), draft.alias("draft"))


def _prefixes(rows: DataFrame, above: float) -> DataFrame:
    """Those of `rows` (library_id, draft, n, id, ...) that a similar draft must share one of, by an order in which rare photos come first.

    Two sets with a similarity over `above` share more than `above` times their sizes, so of the first n - floor(above * n) of each, in one order
    for all, one at least is common. The order goes by how many drafts have a photo (in powers of two), then by a hash; where in it a draft's
    prefix ends is read off its counts by `STEPS` steps of the hash, so that no draft's members are put in order anywhere.
    """
    shared = rows.groupBy("library_id", "id").agg(F.count("*").alias("drafts"))
    ordered = rows.join(shared, ["library_id", "id"]).withColumn("place", F.floor(F.log2("drafts")) * STEPS + F.pmod(F.xxhash64("id"), F.lit(STEPS)))
    counted = ordered.groupBy("library_id", "draft", "n", "place").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("library_id", "draft").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counted.withColumn("before", before).where(F.col("before") < F.col("n") - F.floor(F.lit(above) * F.col("n"))).groupBy("library_id", "draft").agg(F.max("place").alias("last"))
    return ordered.join(ends, ["library_id", "draft"]).where((F.col("place") <= F.col("last")) & (F.col("drafts") > 1)).drop("drafts", "place", "last")


def similar_pairs(drafts: DataFrame, members: DataFrame, above: float = 0.8) -> DataFrame:
    """(library_id, a, b, kind_a, kind_b, similarity): pairs of drafts with a Jaccard similarity over `above`, the one that survives first.

    `drafts` have library_id, draft, kind and n, `members` library_id, draft and id (each once). Drafts of about the same size meet by the photos of
    their prefixes; a photo that many drafts have is in few of these. What meets is counted over all members.
    """
    own = drafts.select("library_id", "draft", "kind", "n")
    rows = shared_checkpoint(_prefixes(members.join(own.select("library_id", "draft", "n"), ["library_id", "draft"]).select("library_id", "draft", "n", "id"), above))
    other = rows.select("library_id", "id", F.col("draft").alias("b"), F.col("n").alias("n_b"))
    met = rows.withColumnRenamed("draft", "a").join(other, ["library_id", "id"]).where((F.col("a") < F.col("b")) & (F.least("n", "n_b") > above * F.greatest("n", "n_b")))
    met = shared_checkpoint(met.select("library_id", "a", "b").distinct())
    held = members.select("library_id", F.col("draft").alias("a"), "id")
    common = met.join(held, ["library_id", "a"]).join(held.withColumnRenamed("a", "b"), ["library_id", "b", "id"]).groupBy("library_id", "a", "b").agg(F.count("*").alias("common"))
    for end in ("a", "b"):
        common = common.join(own.select("library_id", F.col("draft").alias(end), F.col("kind").alias(f"kind_{end}"), F.col("n").alias(f"n_{end}")), ["library_id", end])
    found = common.withColumn("similarity", jaccard(F.col("common"), F.col("n_a"), F.col("n_b"))).where(F.col("similarity") > above)
    turns = [_turn(F.col(f"kind_{end}"), F.col(f"n_{end}"), F.col(end)) for end in ("a", "b")]
    swap = turns[0] > turns[1]

    def first(x: str, y: str, name: str) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)

    return found.select("library_id", first("a", "b", "a"), first("b", "a", "b"), first("kind_a", "kind_b", "kind_a"), first("kind_b", "kind_a", "kind_b"), "similarity")


def similar_by_photo(members: DataFrame, above: float = 0.8) -> DataFrame:
    """(library_id, a, b): as `similar_pairs`, where a photo is in few drafts only, as those of one draft of each kind are.

    `members` have library_id, draft, kind, n and id. The drafts of a photo meet in one row, which tells those of about the same size, and what
    two drafts have in common is counted; so members move once. A photo in very many drafts makes as many pairs: that is what `similar_pairs` is for.
    """
    own = members.repartition("library_id", "id").groupBy("library_id", "id").agg(F.collect_list(F.struct("kind", "n", "draft")).alias("own"))

    def later(x: Column) -> Column:
        alike = F.filter("own", lambda y: (x["draft"] < y["draft"]) & (F.least(x["n"], y["n"]) > above * F.greatest(x["n"], y["n"])))
        return F.transform(alike, lambda y: F.struct(x.alias("x"), y.alias("y")))

    met = own.where(F.size("own") > 1).select("library_id", F.explode(F.flatten(F.transform("own", later))).alias("met"))
    common = met.groupBy("library_id", "met").agg(F.count("*").alias("common"))
    found = common.where(jaccard(F.col("common"), F.col("met.x.n"), F.col("met.y.n")) > above)
    turns = [_turn(F.col(f"met.{end}.kind"), F.col(f"met.{end}.n"), F.col(f"met.{end}.draft")) for end in "xy"]
    return found.select("library_id", F.when(turns[0] > turns[1], F.col("met.y.draft")).otherwise(F.col("met.x.draft")).alias("a"), F.when(turns[0] > turns[1], F.col("met.x.draft")).otherwise(F.col("met.y.draft")).alias("b"))


def folded_drafts(drafts: DataFrame, members: DataFrame, above: float = 0.8) -> DataFrame:
    """(library_id, draft): those to drop, so that no two of the rest have a similarity over `above`.

    Drafts with the same members are one to begin with: all but the first go, whatever becomes of it, so any number of them makes no pairs.
    """
    own = members.groupBy("library_id", "draft").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("one"), F.sum(F.xxhash64("id", F.lit(2)).cast("decimal(38,0)")).alias("two"))
    keyed = drafts.join(own, ["library_id", "draft"])
    keyed = shared_checkpoint(keyed.select("library_id", "draft", "kind", "n", F.struct("n", "one", "two").alias("set")))
    turn = _turn(F.col("kind"), F.col("n"), F.col("draft"))
    firsts = keyed.groupBy("library_id", "set").agg(F.min_by("draft", turn).alias("draft"))
    heads = shared_checkpoint(keyed.join(firsts.select("library_id", "draft"), ["library_id", "draft"], "left_semi").drop("set"))
    copies = keyed.join(heads, ["library_id", "draft"], "left_anti").select("library_id", "draft")
    rest = members.join(copies, ["library_id", "draft"], "left_anti")
    return dropped_drafts(similar_pairs(heads, rest, above)).unionByName(copies)


def dropped_drafts(pairs: DataFrame) -> DataFrame:
    """(library_id, draft): those to drop: a draft goes if an earlier one that stays is too similar (`pairs`: library_id, a before b).

    In each round the drafts that nothing undecided comes before stay, and what is similar to them goes; as many rounds as
    the longest chain of similar drafts is long, one or two as a rule.
    """
    open_ = shared_checkpoint(pairs.select("library_id", "a", "b"))
    gone = open_.select("library_id", F.col("b").alias("draft")).where(F.lit(False))
    while not open_.isEmpty():
        first = open_.select("library_id", "a").distinct().join(open_.select("library_id", F.col("b").alias("a")), ["library_id", "a"], "left_anti")
        fresh = shared_checkpoint(open_.join(first, ["library_id", "a"], "left_semi").select("library_id", F.col("b").alias("draft")).distinct())
        gone = gone.unionByName(fresh)
        left = open_.join(first, ["library_id", "a"], "left_anti")
        for end in ("a", "b"):
            left = left.join(fresh.withColumnRenamed("draft", end), ["library_id", end], "left_anti")
        open_ = shared_checkpoint(left)
    return gone
