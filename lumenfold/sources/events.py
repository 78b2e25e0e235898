"""A photo table derived from a table of events, so that every operator has rows that other engines can derive too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wall_millis(ts: Column) -> Column:
    """Epoch ms of a timestamp without a zone, as a wall clock in UTC, whatever the session's zone is."""
    of_day = (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + of_day.cast("long")  # not a decimal, which takes twice the room wherever photos move


def photos_from_events(events: DataFrame) -> DataFrame:
    """One photo for each event (event_id, ts, user_id, event_type, props), and three more frames for some clicks.

    A projection and one small explode; positions, hashes and statistics are arithmetic on the ids.
    """
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    frames = F.when((F.col("event_type") == "click") & (e % 3 == 0), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = events.withColumn("ms", wall_millis(F.col("ts"))).withColumn("frame", F.explode(frames))
    n = F.col("frame")
    far = (F.floor(F.col("ms") / 86_400_000) + u) % 10 < 3
    placed, filmed = e % 7 != 0, e % 11 != 0
    canon = (u % 2 == 0) & (e % 3 == 0)

    def spread(factor: int, width: int) -> Column:
        return (e * factor % (2 * width + 1) - width) * 1e-5

    lat = F.when(far, 26.212 + spread(7919, 1000)).otherwise(35.646 + u % 40 * 0.01 + spread(7919, 100))
    lon = F.when(far, 127.681 + spread(104729, 1000)).otherwise(139.653 - u % 25 * 0.01 + spread(104729, 100))
    seed = F.when(e % 50 == 0, u).otherwise(-e)
    return rows.select(
        u.alias("library_id"),
        F.concat(F.lit("p"), F.lpad(e.cast("string"), 9, "0"), F.lit("-"), n.cast("string")).alias("id"),
        F.when(e % 41 == 0, F.concat(F.lit("scre shot "), e.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("IMG_"), e.cast("string"), F.lit(".jpg"))).alias("name"),
        F.when(e % 97 != 0, F.col("ms") + 400 * n).alias("taken_at"),
        F.when(placed, lat).alias("lat"),
        F.when(placed, lon).alias("lon"),
        F.concat(F.substring(F.md5(seed.cast("string").cast("binary")), 1, 15), (n + 1).cast("string")).alias("phash"),
        (k / 100).alias("brightness"),
        (e * 31 % 100 / 100).alias("saturation"),
        (e * 17 % 60 / 100).alias("edge_density"),
        ((e * 13 % 60 - 30) / 100).alias("warmth"),
        (e * 7 % 90).cast("double").alias("colorfulness"),
        (e * 19 % 100 / 100).alias("blue_top_ratio"),
        (e * 23 % 100 / 100).alias("green_ratio"),
        F.when(e % 40 == 1, 0.0001).otherwise(0.04).alias("luma_variance"),
        F.when(e % 3 == 0, 1.5).when(e % 3 == 1, 1.0).otherwise(0.75).alias("aspect"),
        F.when(filmed, F.when(canon, "Canon").otherwise("Apple")).alias("camera_make"),
        F.when(filmed, F.when(canon, "EOS R6").otherwise("iPhone 15")).alias("camera_model"),
        F.when(filmed, F.when(e % 2 == 0, 1.8).otherwise(4.0)).alias("f_number"),
        F.when(filmed, 100 * (1 + e % 25)).alias("iso"),
        F.concat(F.lit("#"), F.substring(F.md5(F.concat(F.lit("c"), e.cast("string")).cast("binary")), 1, 6)).alias("top_hex"),
    )


def read_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
