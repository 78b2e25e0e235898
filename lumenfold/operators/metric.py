"""Pairs in reach and density clusters by any metric, without most of the pairs.

Only the triangle inequality is needed. Some points of each library are its pivots. A point's home is its nearest pivot, and pairs are
looked for at the home of their second point: the first one is posted there too if its distance from that pivot is at most `2 * reach`
more than from its own home, for then only can anything there be in reach. At a pivot, points meet by rings of that width, so that
only those at about its distance do; and what is left must differ by no more than `reach` in its distances from all
pivots before the metric itself is asked. These travel as small numbers, an eighth of the reach each. All points of a library with
no more than `few` meet: they are posted nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.operators.places import dbscan

PIVOTS, SALTS = 24, 32
#: Points of a library that meet without pivots, each of which would be asked for every point too; more where the metric costs next to nothing.
FEW = 128
Metric = Callable[[Column, Column], Column]


def metric_pairs(points: DataFrame, metric: Metric, reach: float, key: str = "point", pivots: int = PIVOTS, tried: list[int] | None = None, few: int = FEW) -> DataFrame:
    """(library_id, key, key2, weight2): all ordered pairs of a library at a distance of `reach` or less, each point with itself too.

    `points` have library_id, key, weight and what the metric reads; `metric` maps two structs of these columns to their distance. It
    must be a metric (no negative numbers or nulls, symmetric, with the triangle inequality). `tried` gets how many pairs met and how many of
    them the metric was asked for.
    """
    own = [c for c in points.columns if c not in ("library_id", key, "weight")]
    rows = points.select("library_id", F.col(key).alias("key"), "weight", F.struct(*own).alias("own"))
    large = shared_checkpoint(rows.groupBy("library_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("library_id"))
    some = not large.isEmpty()
    small = rows.join(large, "library_id", "left_anti") if some else rows
    other = small.select("library_id", F.col("key").alias("key2"), F.col("weight").alias("weight2"), F.col("own").alias("own2"))
    direct = small.join(other.hint("merge"), "library_id")
    names = ("library_id", F.col("key").alias(key), F.col("key2").alias(f"{key}2"), "weight2")
    found = direct.where(metric(F.col("own"), F.col("own2")) <= reach).select(*names)
    if not some:
        if tried is not None:
            tried += [direct.count()] * 2
        return found
    rows = rows.join(large, "library_id", "left_semi").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    chosen = rows.groupBy("library_id").agg(F.array_distinct(F.array(*(F.min_by("own", F.struct(F.xxhash64("key", F.lit(k)), F.col("key"))) for k in range(pivots)))).alias("pivots"))
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # a library of any size stays spread
    room = reach * (1 + 1e-9) + 1e-9
    far = rows.join(chosen, ["library_id", "salt"]).withColumn("far", F.transform("pivots", lambda p: metric(F.col("own"), p).cast("double"))).drop("pivots", "salt")
    far = shared_checkpoint(far.withColumn("least", F.array_min("far")))
    # differences of `reach` or less are 8 or less in these, also where they are cut off
    eighths = F.transform("far", lambda d: F.least(F.floor(d * 8 / (room if reach > 0 else 1.0)), F.lit(1 << 24)).cast("float"))
    ring = F.floor(F.col("gap") / (room if reach > 0 else 1.0))
    home = far.withColumn("pivot", F.array_position("far", F.col("least")) - 1).withColumn("gap", F.col("least"))
    home = home.select("library_id", "pivot", ring.alias("ring"), F.col("key").alias("key2"), F.col("weight").alias("weight2"), F.col("own").alias("own2"), eighths.alias("far2"))
    posted = far.select("library_id", "key", "own", eighths.alias("far"), "least", F.posexplode("far").alias("pivot", "gap")).where(F.col("gap") <= F.col("least") + 2 * room).withColumn("pivot", F.col("pivot").cast("long"))
    posted = posted.withColumn("ring", F.explode(F.array(ring - 1, ring, ring + 1))).drop("gap", "least")
    met = posted.join(home, ["library_id", "pivot", "ring"])
    near = met.where(F.forall(F.zip_with("far", "far2", lambda x, y: F.abs(x - y)), lambda d: d <= 8))
    if tried is not None:
        tried += [n + direct.count() for n in (met.count(), near.count())]
    return found.unionByName(near.where(metric(F.col("own"), F.col("own2")) <= reach).select(*names))


def metric_clusters(points: DataFrame, metric: Metric, reach: float, min_points: int, key: str = "point", pivots: int = PIVOTS, few: int = FEW) -> DataFrame:
    """(library_id, key, cluster) of all points that aren't noise, as `dbscan`, by any metric."""
    return dbscan(points, lambda rows: shared_checkpoint(metric_pairs(rows, metric, reach, key, pivots, few=few)), min_points, key)
