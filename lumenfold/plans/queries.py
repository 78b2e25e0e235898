"""Registered queries over the given tables, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.checkpoint import shared_checkpoint, shared_folder
from lumenfold.functions import exif, naming, pixels, png, scalar
from lumenfold.functions import exif_writer as ew
from lumenfold.functions.scene import SCREENSHOT, SCREENSHOT_NAME, classify, labelled
from lumenfold.operators import bursts, places
from lumenfold.operators import timeline as tl
from lumenfold.operators.counts import pairs_within
from lumenfold.operators.covers import best_cover, pick_covers
from lumenfold.operators.home import infer_home
from lumenfold.operators.metric import metric_clusters
from lumenfold.operators.nearest import with_nearest_entry
from lumenfold.plans import oracle
from lumenfold.plans.albums import build_albums, plan_albums
from lumenfold.sources.events import read_photos
from lumenfold.sources.files import registered
from lumenfold.sources.gazetteer import gazetteer_table
from lumenfold.sources.images import scan_images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*ctes: str, sql: str | None = None):
    """Registers a function under its name, with the SQL that selects from the named common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle.with_ctes(ctes, sql)
        return f

    return add


def _labelled(spark, sf_dir, *names):
    """`names` of labelled photos, worked out once: several steps read them."""
    return shared_checkpoint(labelled(read_photos(spark, sf_dir)).select("library_id", "id", *names, "label"))


@query("photos", sql="SELECT library_id, id, name, taken_at, round(lat, 7) AS lat, round(lon, 7) AS lon, phash, round(brightness, 6) AS brightness, camera_model, iso, top_hex FROM photos")
def photo_view(spark, sf_dir):
    return read_photos(spark, sf_dir).select("library_id", "id", "name", "taken_at", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "phash", F.round("brightness", 6).alias("brightness"), "camera_model", "iso", "top_hex")


@query("scenes", sql="SELECT library_id, id, scene, round(scene_confidence, 6) AS scene_confidence FROM scenes")
def scene_labels(spark, sf_dir):
    return classify(read_photos(spark, sf_dir)).select("library_id", "id", "scene", F.round("scene_confidence", 6).alias("scene_confidence"))


@query("scenes", sql="SELECT library_id, label, count(*) AS n, arg_min(id, (-score, id)) AS cover_id FROM scenes WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= 6")
def scene_groups(spark, sf_dir):
    # photos without a label count as none, so the last filter drops them too
    rows = labelled(read_photos(spark, sf_dir))
    return rows.groupBy("library_id", "label").agg(F.count("label").alias("n"), best_cover().alias("cover_id")).where("n >= 6")


@query("photos", sql=f"SELECT library_id, id, name FROM photos WHERE regexp_matches(name, '{SCREENSHOT_NAME}')")
def screenshot_filter(spark, sf_dir):
    return read_photos(spark, sf_dir).where(F.col("name").rlike(SCREENSHOT_NAME)).select("library_id", "id", "name")


@query("scenes", sql="SELECT library_id, id, round(score, 6) AS score FROM scenes")
def cover_scores(spark, sf_dir):
    score = scalar.cover_score(F.col("edge_density"), F.col("brightness"), F.col("colorfulness"))
    return read_photos(spark, sf_dir).select("library_id", "id", F.round(score, 6).alias("score"))


@query("scenes", sql="SELECT library_id, arg_min(id, (-score, id)) AS cover_id FROM scenes GROUP BY library_id")
def pick_cover_per_library(spark, sf_dir):
    return pick_covers(read_photos(spark, sf_dir), "library_id")


@query("homes", sql="SELECT library_id, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon FROM homes")
def grid_home(spark, sf_dir):
    return infer_home(_labelled(spark, sf_dir, "lat", "lon").where(~F.col("label").eqNullSafe(SCREENSHOT))).select("library_id", F.round("home_lat", 6).alias("home_lat"), F.round("home_lon", 6).alias("home_lon"))


@query("photos", sql="SELECT library_id, count(*) AS n, count(*) FILTER (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-6 AND abs(lon) < 1e-6)) AS n_valid FROM photos GROUP BY 1")
def gps_valid(spark, sf_dir):
    return read_photos(spark, sf_dir).groupBy("library_id").agg(F.count("*").alias("n"), F.count_if(scalar.valid_gps(F.col("lat"), F.col("lon"))).alias("n_valid"))


@query(
    "photos",
    "gazetteer",
    sql=f"""SELECT library_id, id, best.name AS name, round(best.m, 3) AS meters FROM (SELECT library_id, id, arg_min(struct_pack(name := name, m := m), (m, ord)) AS best
      FROM (SELECT p.library_id, p.id, g.name, g.ord, {oracle.haversine('p.lat', 'p.lon', 'g.lat', 'g.lon')} AS m FROM photos p, gazetteer g WHERE p.lat IS NOT NULL) GROUP BY 1, 2)""",
)
def nearest_gazetteer(spark, sf_dir):
    rows = places.with_nearest(read_photos(spark, sf_dir).where("lat is not null").select("library_id", "id", "lat", "lon"), "lat", "lon")
    return rows.select("library_id", "id", F.col("near.name").alias("name"), F.round("near.meters", 3).alias("meters"))


@query("photos", "gazetteer", sql=f"""SELECT library_id, id, best.name AS name, round(best.m, 3) AS meters FROM (SELECT library_id, id, arg_min(struct_pack(name := name, m := m), (m, ord)) AS best
      FROM (SELECT p.library_id, p.id, g.name, g.ord, {oracle.haversine('p.lat', 'p.lon', 'g.lat', 'g.lon')} AS m FROM photos p, gazetteer g WHERE p.lat IS NOT NULL) GROUP BY 1, 2)""")
def nearest_place(spark, sf_dir):
    """As `nearest_gazetteer`, with the places as a table of any size."""
    rows = with_nearest_entry(read_photos(spark, sf_dir).where("lat is not null").select("library_id", "id", "lat", "lon"), gazetteer_table(spark))
    return rows.select("library_id", "id", F.col("near.name").alias("name"), F.round("near.meters", 3).alias("meters"))


@query("photos", "shops", sql=f"""SELECT library_id, id, best.name AS name, round(best.m, 3) AS meters FROM (SELECT library_id, id, arg_min(struct_pack(name := name, m := m), (m, ord)) AS best
      FROM (SELECT p.library_id, p.id, g.name, g.ord, {oracle.haversine('p.lat', 'p.lon', 'g.lat', 'g.lon')} AS m FROM photos p, shops g WHERE p.lat IS NOT NULL) GROUP BY 1, 2)""")
def nearest_shop(spark, sf_dir):
    """The nearest of as many places as there are suppliers, most of them around the same towns."""
    k = F.col("s_suppkey").cast("long")
    shops = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("ord"), F.col("s_name").alias("name"), (35.6 + k * 7919 % 1000 * 0.0005).alias("lat"), (139.4 + k * 104729 % 1009 * 0.0005).alias("lon"))
    rows = with_nearest_entry(read_photos(spark, sf_dir).where("lat is not null").select("library_id", "id", "lat", "lon"), shops)
    return rows.select("library_id", "id", F.col("near.name").alias("name"), F.round("near.meters", 3).alias("meters"))


@query("spots", "near", sql="SELECT library_id, sum(weight * weight2)::BIGINT AS n_pairs FROM near GROUP BY 1")
def haversine_pairs(spark, sf_dir):
    spots = read_photos(spark, sf_dir).where("lat is not null").groupBy("library_id", "lat", "lon").agg(F.count("*").alias("weight"))
    return pairs_within(shared_checkpoint(spots), 500.0)


@query(
    "hash_clusters",
    sql="SELECT library_id, rep, cluster FROM hash_clusters",
)
def hash_clusters(spark, sf_dir):
    """Density clusters of the hashes of each library: a metric that isn't one of places."""
    rows = read_photos(spark, sf_dir).where("luma_variance >= 0.0008").groupBy("library_id", scalar.hash_bits(F.col("phash")).alias("bits")).agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    return metric_clusters(shared_checkpoint(rows), lambda a, b: F.bit_count(a["bits"].bitwiseXOR(b["bits"])), 8, 4, "rep", few=4096)


@query("dup_edges", sql="SELECT library_id, a, b FROM dup_edges")
def dup_edges(spark, sf_dir):
    return bursts.dup_edges(read_photos(spark, sf_dir))


@query("burst_edges", sql="SELECT library_id, a, b FROM burst_edges")
def burst_edges(spark, sf_dir):
    return bursts.burst_edges(read_photos(spark, sf_dir))


@query("burst_members", sql="SELECT library_id, id, burst FROM burst_members")
def burst_members(spark, sf_dir):
    return bursts.burst_members(read_photos(spark, sf_dir))


@query("burst_groups", sql='SELECT library_id, burst, n, cover_id, start, "end", subtype FROM burst_groups')
def burst_groups(spark, sf_dir):
    photos = shared_checkpoint(read_photos(spark, sf_dir))
    return bursts.burst_groups(photos, bursts.burst_members(photos))


@query("sessions", sql="SELECT library_id, id, session_start FROM sessions")
def sessions(spark, sf_dir):
    return tl.sessions(read_photos(spark, sf_dir)).select("library_id", "id", "session_start")


def _day_rows(spark, sf_dir):
    photos = read_photos(spark, sf_dir)
    rows = tl.with_home(photos, infer_home(photos)).withColumn("counted", F.lit(True))
    return tl.days(tl.sessions(rows))


@query("all_days", sql='SELECT library_id, day, start, "end", n, round(furthest, 3) AS furthest FROM all_days')
def day_clusters(spark, sf_dir):
    return _day_rows(spark, sf_dir).select("library_id", "day", "start", "end", "n", F.round("furthest", 3).alias("furthest"))


@query("all_runs", sql='SELECT library_id, run, min(start) AS start, max("end") AS "end", count(*) AS n_days, sum(n)::BIGINT AS n FROM all_runs GROUP BY 1, 2')
def runs(spark, sf_dir):
    return tl.trips(tl.runs(_day_rows(spark, sf_dir))).select("library_id", "run", "start", "end", "n_days", "n")


@query("all_runs", sql='SELECT library_id, run, count(*) AS n_days, sum(n)::BIGINT AS n FROM all_runs GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(n) >= 20 AND coalesce(max(furthest) > 30000, true)')
def trips(spark, sf_dir):
    return tl.trips(tl.runs(_day_rows(spark, sf_dir))).where("is_trip").select("library_id", "run", "n_days", "n")


@query("events_of", sql='SELECT library_id, event_kind, event, min(start) AS start, max("end") AS "end", count(*)::INTEGER AS n_days, sum(n_counted)::BIGINT AS n_counted FROM event_days GROUP BY 1, 2, 3')
def timeline(spark, sf_dir):
    rows = _labelled(spark, sf_dir, "taken_at", "lat", "lon", "phash", "luma_variance", "brightness", "edge_density", "colorfulness")
    rows = shared_checkpoint(bursts.with_bursts(rows).drop("phash", "luma_variance"))
    groups = bursts.groups_of(rows.where("burst is not null"))
    rows = rows.where(~F.col("label").eqNullSafe(SCREENSHOT))
    events, _ = tl.timeline(bursts.with_counted(rows, groups), infer_home(rows))
    return events.select("library_id", "event_kind", "event", "start", "end", "n_days", "n_counted")


@query("places_of", sql="SELECT library_id, id, place FROM places_of")
def dbscan_places(spark, sf_dir):
    return places.place_members(_labelled(spark, sf_dir, "lat", "lon", "taken_at").where(~F.col("label").eqNullSafe(SCREENSHOT)))


@query("photos", sql="SELECT library_id, camera_model, count(*) AS n, min(taken_at) AS date_start, max(taken_at) AS date_end FROM photos p WHERE camera_model IS NOT NULL AND (SELECT count(DISTINCT camera_model) FROM photos q WHERE q.library_id = p.library_id) >= 2 GROUP BY 1, 2 HAVING count(*) >= 30")
def device_groups(spark, sf_dir):
    rows = read_photos(spark, sf_dir).where("camera_model is not null").groupBy("library_id", "camera_model").agg(F.count("*").alias("n"), F.min("taken_at").alias("date_start"), F.max("taken_at").alias("date_end"))
    several = rows.groupBy("library_id").agg(F.count("*").alias("models")).where("models >= 2").select("library_id")
    return rows.join(several, "library_id", "left_semi").where("n >= 30")


@query("dates", sql="SELECT day, holiday, season FROM dates")
def holiday_names(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("ms", F.unix_date("d").cast("long") * scalar.DAY_MS)
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), naming.holiday(F.col("ms")).alias("holiday"), naming.season_of(F.month("d")).alias("season"))


@query("paints", sql="SELECT p_partkey, round(h, 5) AS h, round(s, 6) AS s, round(v, 6) AS v FROM paints")
def rgb_hsv(spark, sf_dir):
    h, s, v = scalar.hsv(*_paint())
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(h, 5).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"))


@query("paints", sql="SELECT p_partkey, hex, round(l, 4) + 0 AS l, round(a, 4) + 0 AS a, round(bb, 4) + 0 AS b, round(sqrt((l - 50) * (l - 50) + a * a + bb * bb), 4) AS from_grey FROM paints")
def rgb_lab(spark, sf_dir):
    paint = _paint()
    own = scalar.lab(*paint)
    grey = (F.lit(50.0), F.lit(0.0), F.lit(0.0))
    l, a, b = (F.round(x, 4) + 0.0 for x in own)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalar.rgb_hex(*paint).alias("hex"), l.alias("l"), a.alias("a"), b.alias("b"), F.round(scalar.lab_distance(own, grey), 4).alias("from_grey"))


def _paint():
    key = F.col("p_partkey").cast("long")
    return (key * 7) % 256, (key * 31) % 256, (key * 101) % 256


@query("albums", sql="SELECT * FROM albums")
def albums(spark, sf_dir):
    """The flagship, without its reasons (`album_reasons`) and photos (`album_photos`)."""
    return build_albums(read_photos(spark, sf_dir)).drop("reason")


@query("album_photos", sql="SELECT library_id, album_id, id, shown, turn FROM album_photos")
def album_photos(spark, sf_dir):
    return plan_albums(read_photos(spark, sf_dir))[1]


@query("album_reasons", sql="SELECT library_id, album_id, reason FROM album_reasons")
def album_reasons(spark, sf_dir):
    return build_albums(read_photos(spark, sf_dir)).select("library_id", "album_id", "reason")


@query(
    "ev",
    sql="SELECT e AS event_id, ms // 1000 * 1000 AS taken_at FROM ev",
)
def exif_times(spark, sf_dir):
    """Times written as EXIF text and read back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy:MM:dd HH:mm:ss").alias("text"))
    return events.select("event_id", naming.exif_text_ms(F.col("text")).alias("taken_at"))


@query("tagged", sql="SELECT * FROM tagged")
def exif_tags(spark, sf_dir):
    """JPEG heads with tags in both byte orders, written for each event and read back."""
    e, ts = F.col("event_id"), F.col("ts")
    little, placed = e % 2 == 0, e % 7 != 0
    taken = F.when(e % 13 == 0, "no date").when(e % 23 == 0, "2023:13:32 24:61:61").otherwise(F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
    top = [ew.text(exif.MAKE, F.when(e % 11 != 0, F.when(e % 3 == 0, "Canon").otherwise(" Apple ")), 12), ew.text(exif.MODEL, F.when(e % 11 != 0, F.concat(F.lit("Model "), (e % 170).cast("string"))), 10), ew.whole(exif.ORIENTATION, 1 + e % 8, little)]
    own = [
        ew.text(exif.TAKEN, F.when(e % 31 != 0, taken), 20), ew.text(exif.DIGITIZED, F.date_format(ts + F.expr("interval 1 day"), "yyyy:MM:dd HH:mm:ss"), 20),
        ew.ratios(exif.F_NUMBER, little, (10 + e % 50, F.when(e % 29 == 0, 0).otherwise(10))), ew.whole(exif.ISO, F.when(e % 17 != 0, 100 * (1 + e % 25)), little), ew.ratios(exif.FOCAL, little, (e * 37 % 5000, 1 + e % 7)),
        ew.ratios(exif.EXPOSURE, little, (F.when(e % 19 != 0, F.lit(1)), 1 + e % 4000)), ew.whole(exif.WIDTH, 1000 + e % 5000, little, ew.LONG), ew.whole(exif.HEIGHT, 500 + e % 3000, little),
    ]
    south, west = F.when(e % 3 == 0, F.when(e % 5 == 0, "s").otherwise("S")).otherwise("N"), F.when(e % 4 == 0, "W").otherwise("E")
    gps = [
        ew.text(exif.LAT_REF, south, 2), ew.ratios(exif.LAT, little, (F.when(placed, e * 7 % 90), F.lit(1)), (e * 11 % 60, F.lit(1)), (e * 13 % 6000, F.lit(100))),
        ew.text(exif.LON_REF, west, 2), ew.ratios(exif.LON, little, (e * 17 % 180, F.lit(1)), (e * 19 % 60, F.lit(1)), (e * 23 % 6000, F.lit(100))),
    ]
    # other segments, a stray byte and a marker without a length may come first
    before = F.when(e % 4 == 1, "FFE000104A46494600010100000100010000").when(e % 4 == 2, "00FF01").otherwise("")
    heads = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", exif.exif_fields(ew.jpeg_head(top, own, gps, little, before)).alias("t"))
    return heads.select("event_id", "t.taken_at", *(F.round(f"t.{k}", 9).alias(k) for k in ("lat", "lon")), "t.make", "t.model", "t.orientation", "t.f_number", "t.iso", "t.focal_length", F.round("t.exposure", 9).alias("exposure"), "t.pixel_width", "t.pixel_height")


@F.pandas_udf(T.BinaryType())
def _as_png(rgba: pd.Series) -> pd.Series:
    return rgba.map(lambda x: png.encode(np.frombuffer(x, np.uint8).reshape(64, 64, 4)[..., :3]))


@query("pixel_means", sql="""SELECT 'part-' || p_partkey || '.png' AS name, true AS decoded, 64 AS width, 64 AS height, 1.0::DOUBLE AS aspect, 'mtime' AS taken_at_source, true AS whole, NULL::VARCHAR AS camera_make, brightness, contrast, luma_variance,
  warmth, saturation, blue_top_ratio, green_ratio, edge_density, colorfulness FROM pixel_means""")
def image_source(spark, sf_dir):
    """A PNG file for each part, written to the shared folder, some 1,000 in each folder there, and read back as photos with one look into each."""
    folder = f"{shared_folder(spark).rstrip('/')}/images-{uuid.uuid4()}"
    files = _raster_bytes(spark, sf_dir).select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), _as_png("rgba").alias("content"))
    folders = 1 + spark.read.parquet(f"{sf_dir}/part.parquet").count() // 1000
    registered(spark)
    files.write.format("photo_files").option("path", folder).option("folders", str(folders)).mode("append").save()
    names = "contrast luma_variance warmth saturation blue_top_ratio green_ratio edge_density".split()
    return scan_images(spark, folder, colors=False).select(
        "name", "decoded", "width", "height", "aspect", "taken_at_source", (F.col("bytes_read") == F.col("size_bytes")).alias("whole"), "camera_make", F.round(F.col("brightness") + 1e-9, 6).alias("brightness"),
        *(F.round(n, 6).alias(n) for n in names), F.round("colorfulness", 4).alias("colorfulness"),
    )


def _raster_bytes(spark, sf_dir):
    """A raster for each part, whose pixels are digests of its key: 97 of them, again and again."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    digests = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(97)), lambda i: F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), (i % 97).cast("string")).cast("binary"))), "")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    again = F.transform(F.array(F.unhex(digests)), lambda once: F.substring(F.concat(*[once] * 11), 1, 1024 * 16))  # digests are read from hex once, not eleven times
    return part.repartition(parts, "p_partkey").select("p_partkey", F.get(again, F.lit(0)).alias("rgba"))  # a small file is one task, and features take time


def _rasters(spark, sf_dir, *names):
    """Features `px` of the rasters."""
    return _raster_bytes(spark, sf_dir).select("p_partkey", pixels.features_udf(*names)("rgba", F.lit(64), F.lit(64), F.col("p_partkey").cast("long")).alias("px"))


@query()
def pixel_stats(spark, sf_dir):
    """Hashes and the main colour, which come of a transform and of seeded clusters; in the tests beside slow versions of both."""
    return _rasters(spark, sf_dir, "phash", "ahash", "top_hexes", "top_weights").select("p_partkey", "px.phash", "px.ahash", F.get("px.top_hexes", F.lit(0)).alias("top_hex"), F.round(F.get("px.top_weights", F.lit(0)), 6).alias("top_weight"))


@query("cosines", "pixel_hashes", sql="SELECT * FROM pixel_hashes")
def pixel_hashes(spark, sf_dir):
    return _rasters(spark, sf_dir, "phash").select("p_partkey", "px.phash")


@query("pixel_means", sql="SELECT * FROM pixel_means")
def pixel_means(spark, sf_dir):
    names = "contrast luma_variance warmth highlights saturation blue_top_ratio green_ratio edge_density".split()
    # means of whole numbers can lie on a rounding edge, and engines add them up in other orders
    return _rasters(spark, sf_dir, "brightness", "colorfulness", "ahash", *names).select("p_partkey", F.round(F.col("px.brightness") + 1e-9, 6).alias("brightness"), *(F.round(f"px.{n}", 6).alias(n) for n in names), F.round("px.colorfulness", 4).alias("colorfulness"), "px.ahash")


@query(
    "photos",
    sql="""SELECT library_id, id, CASE WHEN taken_at IS NULL THEN '日付不明' ELSE strftime(d, '%-m/%-d') || CASE WHEN until = d THEN '' ELSE '〜' || strftime(until, '%-m/%-d') END END AS dates,
      CASE iso % 3 WHEN 0 THEN '高' WHEN 1 THEN '中' ELSE '低' END AS label, CASE iso % 3 WHEN 0 THEN 'かなり自信あり' WHEN 1 THEN 'まあまあ自信あり' ELSE '自信ひかえめ' END AS word, 3 - (iso % 3)::INT AS dots,
      CASE WHEN iso % 5 = 0 THEN 'いつもの場所' WHEN iso % 2 = 0 THEN 'この場所' ELSE 'はじめての場所' END AS place,
      CASE WHEN warmth < -0.1 THEN -0.1 WHEN warmth > 0.1 THEN 0.1 ELSE warmth END AS clamped, bit_count((iso * 7919) & 4294967295)::INT AS bits, floor((((colorfulness * 11 - 200) % 360 + 360) % 360) / 360 * 12)::INT AS hue_bin
      FROM (SELECT library_id, id, taken_at, warmth, colorfulness, DATE '1970-01-01' + floor(taken_at / 86400000.0)::INT AS d, DATE '1970-01-01' + floor((taken_at + 3600000 * (colorfulness::BIGINT % 30)) / 86400000.0)::INT AS until, coalesce(iso, 0) // 100 AS iso FROM photos)""",
)
def shown_words(spark, sf_dir):
    """Words and numbers that albums are shown with, over values of photos."""
    iso = F.floor(F.coalesce("iso", F.lit(0)) / 100)
    sure = F.when(iso % 3 == 0, "high").when(iso % 3 == 1, "med").otherwise("low")
    until = F.col("taken_at") + 3_600_000 * (F.col("colorfulness").cast("long") % 30)
    return read_photos(spark, sf_dir).select(
        "library_id", "id", naming.date_range_text(F.col("taken_at"), until).alias("dates"), naming.confidence_label(sure).alias("label"), naming.confidence_word(sure).alias("word"), naming.confidence_dots(sure).alias("dots"),
        naming.relative_name(iso % 5 == 0, iso % 2 == 0).alias("place"), scalar.clamp(F.col("warmth"), -0.1, 0.1).alias("clamped"), scalar.popcount32(iso * 7919).alias("bits"), scalar.hue_bin(F.col("colorfulness") * 11 - 200, 12).alias("hue_bin"),
    )
