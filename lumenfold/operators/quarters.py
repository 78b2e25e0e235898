"""Cells of a quadtree over the globe, and bounds of distances between what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import EARTH_METERS

#: More than distances can be off by rounding.
MARGIN = 1e-4


def cell_of(level: int, lat: Column | None = None, lon: Column | None = None) -> Column:
    """The row and column of a place among the cells of a level, as one number."""
    lat, lon = F.col("lat") if lat is None else lat, F.col("lon") if lon is None else lon
    rows = F.least(F.lit((1 << level) - 1), F.floor((lat + 90) / 180 * (1 << level)))
    columns = F.pmod(F.floor((lon + 180) / 360 * (1 << level)), F.lit(1 << level))
    return rows * (1 << level) + columns


def above(cell: Column, level: int, by: int = 1) -> Column:
    """The cell that is `by` levels above."""
    return F.shiftright(F.shiftright(cell, level), by) * (1 << level - by) + F.shiftright(cell.bitwiseAND(F.lit((1 << level) - 1)), by)


def nodes_of(points: DataFrame, level: int, *keys: str) -> DataFrame:
    """(keys, cell, lat, lon, far, n, weight): the middle of the places of each cell and key, and no less than how far they lie from it."""
    ends = points.groupBy(*keys, cell_of(level).alias("cell")).agg(
        F.count("*").alias("n"), F.sum("weight").alias("weight"), *(f(c).alias(f"{name}_{c}") for c in ("lat", "lon") for name, f in (("low", F.min), ("high", F.max)))
    )
    middle = {c: (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2 for c in ("lat", "lon")}
    # along the parallel of the middle, and then along a meridian
    far = EARTH_METERS * (F.radians((F.col("high_lat") - F.col("low_lat")) / 2) + F.cos(F.radians(middle["lat"])) * F.radians((F.col("high_lon") - F.col("low_lon")) / 2))
    return ends.select(*keys, "cell", middle["lat"].alias("lat"), middle["lon"].alias("lon"), far.alias("far"), "n", "weight")
