"""The best photo of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import cover_score


def best_cover() -> Column:
    """An aggregate: the id with the highest score; ties go to the smallest id."""
    return F.min_by("id", F.struct(-cover_score(F.col("edge_density"), F.col("brightness"), F.col("colorfulness")), F.col("id")))


def pick_covers(photos: DataFrame, *keys: str) -> DataFrame:
    return photos.groupBy(*keys).agg(best_cover().alias("cover_id"))
