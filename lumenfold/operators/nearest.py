"""The nearest entry of a table of places, of any size, for each row.

The globe is cut into quarters, again and again, but only where rows are. Each cell keeps the entries that can be the nearest one of any
place in it: those no further from its centre than the nearest entry and the cell's width. A quarter's candidates are among those of
the cell above, so the table is narrowed down and never searched as a whole for a row. Cells with few candidates are done; their
lists are joined to the rows, and distances are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import EARTH_METERS, haversine
from lumenfold.operators.quarters import MARGIN, above, cell_of

#: Cells with so many candidates are done; so are all of the last level, some 10 m wide, so that lists stay short where entries are dense. Each
#: round goes down `STEP` levels, only where lists are still long.
FEW, LAST, STEP = 24, 22, 2


def _reach(cell: Column, level: int) -> tuple[Column, Column, Column]:
    """The latitude and longitude of a cell's centre, and no less than how far its places are from it."""
    high, wide = 180 / (1 << level), 360 / (1 << level)
    lat, lon = (F.shiftright(cell, level) + 0.5) * high - 90, (cell.bitwiseAND(F.lit((1 << level) - 1)) + 0.5) * wide - 180
    return lat, lon, EARTH_METERS * (F.radians(F.lit(high / 2)) + F.cos(F.radians(lat)) * F.radians(F.lit(wide / 2)))


def with_nearest_entry(rows: DataFrame, entries: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "near", few: int = FEW) -> DataFrame:
    """`rows` with a struct (meters, ord, name) of the nearest of `entries` (ord, name, lat, lon); of equally near ones that with the smallest `ord`.

    Null for rows without a place, or if there are no entries; entries without a place take no part.
    """
    held = entries.where("lat is not null and lon is not null").select("ord", "name", F.col("lat").alias("y"), F.col("lon").alias("x"))
    spot = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")))
    placed = rows.withColumn("__spot", spot)
    cells = placed.where("__spot is not null").select("__spot.*").select(cell_of(LAST).alias("deep")).distinct()
    alive = shared_checkpoint(cells.withColumn("cell", F.lit(0).cast("long")))
    wanted, done = held.withColumn("cell", F.lit(0).cast("long")), []
    for level in range(STEP, LAST + 1, STEP):
        alive = alive.withColumns({"parent": F.col("cell"), "cell": above(F.col("deep"), LAST, LAST - level) if level < LAST else F.col("deep")})
        y, x, reach = _reach(F.col("cell"), level)
        # entries of the cell above, for each of its parts in which rows are
        met = alive.select("parent", "cell").distinct().join(wanted.withColumnRenamed("cell", "parent"), "parent").withColumn("far", haversine(y, x, F.col("y"), F.col("x"))).drop("parent")
        met = shared_checkpoint(met)
        nearest = met.groupBy("cell").agg(F.min("far").alias("least"))
        near = shared_checkpoint(met.join(nearest, "cell").where(F.col("far") <= F.col("least") + 2 * reach + MARGIN).drop("far", "least"))
        sizes = shared_checkpoint(near.groupBy("cell").agg(F.count("*").alias("n")))
        ended = sizes.select("cell") if level == LAST else sizes.where(F.col("n") <= few).select("cell")
        lists = near.join(ended, "cell", "left_semi").groupBy("cell").agg(F.collect_list(F.struct("ord", "name", "y", "x")).alias("entries"))
        done.append((alive.join(ended, "cell", "left_semi").select("deep", "cell", F.lit(level).alias("level")), lists.withColumn("level", F.lit(level))))
        alive = shared_checkpoint(alive.join(ended, "cell", "left_anti").select("deep", "cell"))
        if alive.isEmpty():
            break
        wanted = near.join(ended, "cell", "left_anti")
    found, lists = done[0]
    for more, own in done[1:]:
        found, lists = found.unionByName(more), lists.unionByName(own)
    index = shared_checkpoint(found.join(lists, ["level", "cell"]).select(F.col("deep").alias("__deep"), F.col("entries").alias("__entries")))
    keyed = placed.withColumn("__deep", F.when(F.col("__spot").isNotNull(), _deep(F.col("__spot"))))
    best = F.array_min(F.transform("__entries", lambda e: F.struct(haversine(F.col("__spot.lat"), F.col("__spot.lon"), e["y"], e["x"]).alias("meters"), e["ord"].alias("ord"), e["name"].alias("name"))))
    return keyed.join(index, "__deep", "left").withColumn(name, best).drop("__deep", "__entries", "__spot")


def _deep(spot: Column) -> Column:
    return F.element_at(F.transform(F.array(spot), lambda s: cell_of(LAST, s["lat"], s["lon"])), 1)
