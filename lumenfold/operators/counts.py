"""How many pairs of places lie within a radius, without listing them: a quadtree that is opened only where it has to be.

Places are counted in cells of a quadtree over the globe. A pair of cells that lies wholly within the radius adds the product of its
weights, one that lies wholly beyond adds nothing, and only the pairs in between are opened into their quarters; those of
few places meet place by place. The bounds come of the triangle inequality: from the distance of the cells' centres and from how far
their places can be from these. So a crowded place costs a few pairs of cells, and a crowded region those along the radius.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import EARTH_METERS, haversine
from lumenfold.operators.places import near_pairs
from lumenfold.operators.quarters import MARGIN, above, cell_of, nodes_of

#: Pairs of cells with so many pairs of places meet place by place; so do all after `LEVELS` rounds, when cells are some centimeters wide.
FEW, LEVELS = 256, 14


def pairs_within(points: DataFrame, meters: float, made: list[int] | None = None) -> DataFrame:
    """(library_id, n_pairs): ordered pairs of photos at most `meters` apart, each with itself too; weights count photos at one place.

    `points` have library_id, lat, lon and weight. `made` gets how many pairs of cells each round looks at, and of places in the end.
    """
    points = points.select("library_id", "lat", "lon", F.col("weight").cast("long").alias("weight"))
    level = max(1, math.floor(math.log2(180 * 111_195 / meters)))
    nodes = shared_checkpoint(nodes_of(points, level, "library_id"))
    widest = EARTH_METERS * 1.5 * math.pi / (1 << level)  # half a cell's height and width
    met = near_pairs(nodes.select("library_id", F.col("cell").alias("node"), "lat", "lon", "weight"), meters + 2 * widest + 1, "node").where("node <= node2")
    open_ = shared_checkpoint(met.select("library_id", F.col("node").alias("a"), F.col("node2").alias("b")))
    sums, held = [], points
    for left in range(LEVELS, -1, -1):
        if made is not None:
            made.append(open_.count())
        pairs = open_
        for k in ("a", "b"):
            pairs = pairs.join(nodes.select("library_id", F.col("cell").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("lat", "lon", "far", "n", "weight"))), ["library_id", k])
        apart, room = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), F.col("far_a") + F.col("far_b")
        state = F.when(apart + room <= meters - MARGIN, "inside").when(apart - room > meters + MARGIN, "outside")
        state = state.when((F.col("n_a") * F.col("n_b") <= FEW) | F.lit(left == 0), "few").otherwise("open")
        twice = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
        judged = shared_checkpoint(pairs.withColumn("state", state).where("state <> 'outside'").select("library_id", "a", "b", "state", F.when(F.col("state") == "inside", twice * F.col("weight_a") * F.col("weight_b")).alias("n_pairs")))
        sums.append(judged.where("state = 'inside'").select("library_id", "n_pairs"))
        here = held.select("library_id", cell_of(level).alias("a"), "lat", "lon", "weight")
        there = here.select("library_id", F.col("a").alias("b"), *(F.col(c).alias(f"{c}2") for c in ("lat", "lon", "weight")))
        one_by_one = judged.where("state = 'few'").select("library_id", "a", "b").join(here, ["library_id", "a"]).join(there, ["library_id", "b"])
        if made is not None:
            made.append(one_by_one.count())
        one_by_one = one_by_one.where(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= meters)
        sums.append(shared_checkpoint(one_by_one.groupBy("library_id").agg(F.sum(twice * F.col("weight") * F.col("weight2")).alias("n_pairs"))))
        straddling = judged.where("state = 'open'").select("library_id", "a", "b")
        if straddling.isEmpty():
            break
        cells = straddling.select("library_id", F.col("a").alias("cell")).unionByName(straddling.select("library_id", F.col("b").alias("cell"))).distinct()
        held = shared_checkpoint(held.withColumn("cell", cell_of(level)).join(cells, ["library_id", "cell"], "left_semi").drop("cell"))
        level += 1
        nodes = shared_checkpoint(nodes_of(held, level, "library_id"))
        quarters = nodes.select("library_id", "cell", above(F.col("cell"), level).alias("up"))
        open_ = straddling
        for k in ("a", "b"):
            open_ = open_.join(quarters.select("library_id", F.col("up").alias(k), F.col("cell").alias(f"own_{k}")), ["library_id", k])
        # quarters of one cell meet once
        open_ = shared_checkpoint(open_.where((F.col("a") != F.col("b")) | (F.col("own_a") <= F.col("own_b"))).select("library_id", F.col("own_a").alias("a"), F.col("own_b").alias("b")))
    total = sums[0]
    for rows in sums[1:]:
        total = total.unionByName(rows)
    return total.groupBy("library_id").agg(F.sum("n_pairs").alias("n_pairs"))
