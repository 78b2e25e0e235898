"""The whole query: photo rows in, explained and ordered albums out.

Every photo row gets the drafts it belongs to (event, place, burst, scene, device) as columns first; drafts are then
one explode and one aggregation, and later steps work on the small table of drafts. `library_id` is in the key of
every join, window and aggregation, together with the photo's or draft's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint, shared_table
from lumenfold.functions import naming
from lumenfold.functions.scalar import album_priority, cover_score, haversine
from lumenfold.functions.scene import SCREENSHOT, labelled
from lumenfold.operators import bursts, places
from lumenfold.operators import timeline as tl
from lumenfold.operators.covers import best_cover
from lumenfold.operators.dedupe import dropped_drafts, similar_by_photo
from lumenfold.operators.home import infer_home
from lumenfold.options import AlbumOptions


#: What the steps read of a photo, beside its label.
READ = ("library_id", "id", "taken_at", "lat", "lon", "phash", "luma_variance", "brightness", "edge_density", "colorfulness", "camera_model")


#: Kinds of drafts that places name.
NAMED = ("trip", "day", "place")


def assigned(photos: DataFrame, options: AlbumOptions = AlbumOptions()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(photos with the keys of their drafts, events, bursts, homes)."""
    rows = shared_table(labelled(photos, options.scene_floor).select(*READ, "label"))  # several branches read it, some columns each
    rows = shared_table(bursts.with_bursts(rows, options.bursts).drop("phash", "luma_variance"))
    groups = shared_checkpoint(bursts.groups_of(rows.where("burst is not null"), options.bursts))
    event_rows = rows.where(~F.col("label").eqNullSafe(SCREENSHOT))
    homes = shared_checkpoint(infer_home(event_rows))
    events, in_events = tl.timeline(bursts.with_counted(event_rows, groups), homes, options=options.timeline)
    in_places = places.place_members(event_rows, options.places)
    keyed = rows.join(in_events, ["library_id", "id"], "left").join(in_places, ["library_id", "id"], "left")
    keyed = keyed.join(homes, "library_id", "left").withColumn("meters", haversine(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")))
    return shared_table(keyed.drop("home_lat", "home_lon")), events, groups, homes


def _draft(kind: Column | str, key: Column, when: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(kind.alias("kind"), key.cast("string").alias("key")))


def _kind() -> Column:
    return F.substring_index("draft", ":", 1)


def draft_members(keyed: DataFrame) -> DataFrame:
    """A row for each photo of each possible draft."""
    scene = F.when(F.col("label") == SCREENSHOT, "screenshot").otherwise("scene")
    every = F.array(
        _draft(F.col("event_kind"), F.col("event"), F.col("event").isNotNull()),
        _draft("place", F.col("place"), F.col("place").isNotNull()),
        _draft("burst", F.col("burst"), F.col("burst").isNotNull()),
        _draft(scene, F.col("label"), F.col("label").isNotNull()),
        _draft("device", F.col("camera_model"), F.coalesce(F.col("camera_model"), F.lit("")) != ""),
    )
    out = keyed.withColumn("own", F.explode(F.filter(every, lambda d: d.isNotNull())))
    return out.withColumns({"kind": F.col("own.kind"), "draft": F.concat_ws(":", "own.kind", "own.key")}).drop("own")


def _summed(options: AlbumOptions) -> list[Column]:
    """What every kind of draft needs to know of its photos, in few bytes as each task sends it; places only where they name a draft."""
    placed = F.col("kind").isin(*NAMED) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    far = (F.col("meters") > options.timeline.far_meters) & (F.col("kind") == "trip")
    return [
        F.count("*").alias("n"),
        F.min("taken_at").alias("date_start"),
        F.max("taken_at").alias("date_end"),
        F.min(F.struct(-cover_score(F.col("edge_density"), F.col("brightness"), F.col("colorfulness")), F.col("id"))).alias("best"),
        F.count_if(placed).alias("placed"),
        *(F.sum(F.when(placed, F.col(x))).alias(f"sum_{x}") for x in ("lat", "lon")),
        *(F.avg(F.when(far, F.col(x))).alias(f"far_{x}") for x in ("lat", "lon")),
    ]


def drafts(keyed: DataFrame, events: DataFrame, groups: DataFrame, homes: DataFrame, options: AlbumOptions = AlbumOptions()) -> tuple[DataFrame, DataFrame]:
    """(drafts that are large enough, all members of possible drafts)."""
    members = draft_members(keyed)
    kind, n = F.col("kind"), F.col("n")
    # before the joins, what can't be large: most drafts are small
    least = F.when(kind == "place", options.min_place_photos).when(kind == "burst", options.bursts.min_burst_size).when(kind == "device", options.min_device_photos).when(kind.isin("scene", "screenshot"), options.min_scene_photos).otherwise(0)
    # by what the joins go by, so that drafts move once
    rows = members.groupBy("library_id", "draft").agg(*_summed(options)).withColumns({"kind": _kind(), "cover_id": F.col("best.id")}).drop("best").where(n >= least)
    own_events = events.select("library_id", F.concat_ws(":", "event_kind", F.col("event").cast("string")).alias("draft"), "n_counted", "nights")
    own_bursts = groups.select("library_id", F.concat(F.lit("burst:"), "burst").alias("draft"), "subtype")
    models = keyed.where(F.coalesce(F.col("camera_model"), F.lit("")) != "").groupBy("library_id").agg(F.count_distinct("camera_model").alias("n_models"))
    rows = rows.join(own_events, ["library_id", "draft"], "left").join(own_bursts, ["library_id", "draft"], "left").join(models, "library_id", "left").join(homes, "library_id", "left")
    trip = F.col("kind") == "trip"
    lat, lon = (F.when(trip & F.col(f"far_{x}").isNotNull(), F.col(f"far_{x}")).otherwise(F.try_divide(f"sum_{x}", "placed")) for x in ("lat", "lon"))
    # written once, as the conditions below would each repeat the search for the nearest place
    rows = shared_checkpoint(places.with_nearest(rows.withColumns({"mid_lat": lat, "mid_lon": lon}), "mid_lat", "mid_lon"))
    radius = F.when(trip, options.city_meters).otherwise(options.place_meters)
    named = F.col("kind").isin(*NAMED)
    known = F.coalesce(named & (F.col("near.meters") <= radius), F.lit(False))
    at_home = F.coalesce(named & (haversine(F.col("home_lat"), F.col("home_lon"), F.col("mid_lat"), F.col("mid_lon")) <= options.home_meters), F.lit(False))
    rows = rows.withColumns({"place_known": known, "place_home": at_home}).withColumn("place_name", F.when(F.col("place_known"), F.col("near.name")))
    enough = (
        F.when(kind == "trip", True)
        .when(kind == "day", F.col("n_counted") >= options.min_event_photos)
        .when(kind == "place", (n >= options.min_place_photos) & (F.col("place_known") | F.col("place_home")))
        .when(kind == "burst", n >= options.bursts.min_burst_size)
        .when(kind == "device", (n >= options.min_device_photos) & (F.col("n_models") >= 2))
        .otherwise(n >= options.min_scene_photos)
    )
    sure = F.when(kind.isin("trip", "burst", "screenshot"), "high").when(kind == "day", F.when(F.col("n_counted") >= options.sure_event_photos, "high").otherwise("med"))
    sure = sure.when(kind == "place", F.when(F.col("place_known"), "med").otherwise("low")).otherwise("med")
    label = F.when(kind == "scene", F.substring_index("draft", ":", -1))
    device = F.when(kind == "device", F.expr("substring(draft, 8)"))
    kept = rows.where(enough).select(
        "library_id", "draft", "kind", "n", "cover_id", "date_start", "date_end", "nights", "subtype", "place_known", "place_home", "place_name", sure.alias("confidence"), label.alias("scene_label"), device.alias("device_model")
    )
    return kept, members.select("library_id", "id", "draft", "taken_at", "label")


def monthly(keyed: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drafts by month, members) of photos that no album has; photos without a time are one draft."""
    date = naming.date_of(F.col("taken_at"))
    rest = keyed.join(covered, ["library_id", "id"], "left_anti").withColumns({"year": F.year(date), "month": F.month(date)})
    rest = rest.withColumn("draft", F.concat_ws(":", F.lit("monthly"), F.coalesce("year", F.lit(0)), F.coalesce("month", F.lit(0))))
    grouped = rest.groupBy("library_id", "draft", "year", "month").agg(F.count("*").alias("n"), F.min("taken_at").alias("date_start"), F.max("taken_at").alias("date_end"), best_cover().alias("cover_id"))
    rows = grouped.withColumns({"kind": F.lit("monthly"), "confidence": F.lit("low")})
    return rows, rest.select("library_id", "id", "draft", "taken_at", "label")


def scene_tags(members: DataFrame, most: int = 3) -> DataFrame:
    """(library_id, draft, scene_tags): the commonest labels of an album's photos but its own (`scene_label`), at most three, comma-joined."""
    rows = members.where(F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("scene_label")))
    counted = rows.groupBy("library_id", "draft", "label").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("library_id", "draft").orderBy(F.desc("n"), "label"))
    best = counted.withColumn("k", first).where(F.col("k") <= most)
    tags = F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda t: t["label"])
    return best.groupBy("library_id", "draft").agg(F.array_join(tags, ",").alias("scene_tags"))


def plan_albums(photos: DataFrame, options: AlbumOptions = AlbumOptions()) -> tuple[DataFrame, DataFrame]:
    """(albums, their photos).

    Albums have a `rank` in their library, from 1, in order of display. Photos are rows (library_id, album_id, id, shown, turn): an
    album lists its photos by `turn`, then id (places by id only; photos without a time come last); `shown` is 0 for the cover and
    1 for the rest, so an order by shown, turn and id shows the cover first. No album is gathered into one row. Every photo is in
    one album at least.
    """
    keyed, events, groups, homes = assigned(photos, options)
    large, members = drafts(keyed, events, groups, homes, options)
    large = shared_checkpoint(large)
    # photos of drafts move three times: to their drafts, to each other, and to the drafts that stay, with all that later steps need of these
    in_large = shared_table(members.join(large.select("library_id", "draft", "n"), ["library_id", "draft"]))
    gone = shared_checkpoint(dropped_drafts(similar_by_photo(in_large.withColumn("kind", _kind()), options.max_jaccard)))
    kept = shared_checkpoint(large.join(gone, ["library_id", "draft"], "left_anti"))
    told = ("library_id", "draft", "cover_id", "scene_label")
    in_kept = shared_table(in_large.drop("n").join(kept.select(*told), ["library_id", "draft"]))
    by_month, in_months = monthly(keyed, in_kept.select("library_id", "id"))
    albums = shared_checkpoint(kept.unionByName(by_month, allowMissingColumns=True))
    in_months = in_months.join(by_month.select("library_id", "draft", "cover_id"), ["library_id", "draft"])
    all_members = in_kept.unionByName(in_months.withColumn("scene_label", F.lit(None).cast("string"))).withColumn("kind", _kind())
    titled = albums.join(scene_tags(all_members), ["library_id", "draft"], "left")
    title, emoji = naming.title_and_emoji()
    album_id = F.concat_ws("-", "kind", "cover_id")
    titled = titled.withColumns({"title": title, "emoji": emoji, "reason": naming.reason(), "album_id": album_id, "scene_tags": F.coalesce("scene_tags", F.lit(""))})
    order = Window.partitionBy("library_id").orderBy(album_priority(F.col("kind")), F.desc_nulls_last("date_end"), "album_id")
    listed = titled.select("library_id", F.row_number().over(order).alias("rank"), "album_id", "kind", "title", "emoji", "reason", "confidence", "n", "cover_id", "scene_tags", "date_start", "date_end")
    turn = F.when(F.col("kind") == "place", 0).otherwise(F.coalesce("taken_at", F.lit(2**62)))
    return listed, all_members.select("library_id", album_id.alias("album_id"), "id", F.when(F.col("id") == F.col("cover_id"), 0).otherwise(1).alias("shown"), turn.alias("turn"))


def build_albums(photos: DataFrame, options: AlbumOptions = AlbumOptions()) -> DataFrame:
    """The albums of `plan_albums`."""
    return plan_albums(photos, options)[0]
