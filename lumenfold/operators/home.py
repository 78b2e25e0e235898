"""Where the owner of a library lives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import grid_cell

CELL_METERS, LEAST_PHOTOS = 1_000.0, 3


def infer_home(photos: DataFrame) -> DataFrame:
    """(library_id, home_lat, home_lon): the mean place of the fullest cell of each library, if it has three photos.

    Ties go to the smaller cell key. Photos are summed up by cell before libraries meet, so a large library stays spread.
    """
    cells = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("library_id", grid_cell(F.col("lat"), F.col("lon"), CELL_METERS).alias("cell"))
    cells = cells.agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    best = cells.groupBy("library_id").agg(F.min_by(F.struct("n", "lat", "lon"), F.struct(-F.col("n"), "cell")).alias("best"))
    return best.where(F.col("best.n") >= LEAST_PHOTOS).select("library_id", F.col("best.lat").alias("home_lat"), F.col("best.lon").alias("home_lon"))
