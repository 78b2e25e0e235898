import math
import random
import re
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from photos import NAMES, SCHEMA, at, demo, demo_photos, frame, photo
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions import naming, scalar
from lumenfold.functions.scene import classify, warm_hue
from lumenfold.operators import bursts, counts, nearest, places
from lumenfold.operators import components as components_module
from lumenfold.operators import timeline as tl
from lumenfold.operators.components import components, stars_of
from lumenfold.operators.dedupe import dropped_drafts, folded_drafts, similar_by_photo, similar_pairs
from lumenfold.operators.home import infer_home
from lumenfold.operators.metric import metric_clusters, metric_pairs
from lumenfold.operators.nearest import with_nearest_entry
from lumenfold.options import AlbumOptions, TimelineOptions
from lumenfold.plans import oracle
from lumenfold.plans.albums import build_albums, plan_albums


@pytest.fixture(scope="module")
def built(spark):
    other = [(2, *photo(f"x{i}", taken_at=at(2025, 1, 1 + i))[1:]) for i in range(3)] + [(3, *photo("solo")[1:])]
    rows = demo() + other
    random.Random(5).shuffle(rows)
    albums, members = plan_albums(frame(spark, rows).repartition(3))
    return rows, albums.orderBy("library_id", "rank").collect(), members.collect()


def expected(rows, select):
    """What the queries' SQL gives for these rows in DuckDB, from all pairs and plain recursion."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("own_photos", pd.DataFrame(rows, columns=NAMES).astype({"taken_at": "Int64", "iso": "Int64"}))
    held = dict(oracle.CTES)
    oracle.CTES["photos"] = ((), "SELECT * FROM own_photos")
    try:
        return con.execute(oracle.with_ctes(("albums", "album_photos"), select)).fetchall()
    finally:
        oracle.CTES.clear()
        oracle.CTES.update(held)


def test_albums_equal_a_slow_computation(built):
    rows, albums, members = built
    names = "library_id, rank, album_id, kind, title, emoji, confidence, n, cover_id, scene_tags, date_start, date_end"
    assert [tuple(a[k] for k in names.split(", ")) for a in albums] == expected(rows, f"SELECT {names} FROM albums ORDER BY 1, 2")
    assert sorted((m.library_id, m.album_id, m.id, m.shown, m.turn) for m in members) == expected(rows, "SELECT library_id, album_id, id, shown, turn FROM album_photos ORDER BY 1, 2, 3")


def test_demo_table(spark):
    rows = demo_photos(spark)
    assert rows.columns == NAMES and rows.count() == len(demo()) == rows.select("id").distinct().count() > 150


def test_albums_of_the_demo(built):
    found = [(a.kind, a.title, a.n) for a in built[1] if a.library_id == 1]
    assert {k for k, _, _ in found} == set(scalar.KINDS)
    assert ("trip", "函館、1泊2日の旅", 26) in found and ("day", "建国記念の日のおでかけ", 9) in found and ("device", "PENTAX K-3で撮った写真", 36) in found
    assert ("burst", "そっくりさんフォト（5枚）", 5) in found and ("burst", "にたものコレクション", 4) in found and ("screenshot", "スクショ整理", 9) in found
    assert [(a.kind, a.n) for a in built[1] if a.library_id == 2] == [("monthly", 3)] and [(a.title, a.n) for a in built[1] if a.library_id == 3] == [("いつかの写真たち", 1)]
    assert all(a.title and a.emoji and a.reason for a in built[1])


def test_every_photo_is_in_an_album_covers_come_first_and_no_two_are_alike(built):
    rows, albums, members = built
    own = {}
    for m in sorted(members, key=lambda m: (m.library_id, m.album_id, m.shown, m.turn, m.id)):
        own.setdefault((m.library_id, m.album_id), []).append(m.id)
    assert {(k, x) for (k, _), ids in own.items() for x in ids} == {(r[0], r[1]) for r in rows}
    assert all(own[a.library_id, a.album_id][0] == a.cover_id and len(own[a.library_id, a.album_id]) == len(set(own[a.library_id, a.album_id])) == a.n for a in albums)
    sets = [(k, set(v)) for k, v in own.items()]
    assert all(len(x & y) <= 0.8 * len(x | y) for (k, x), (m, y) in combinations(sets, 2) if k[0] == m[0])


def test_options_reach_the_names_of_trips(spark):
    rows = [photo(f"home{k}", lat=43.06, lon=141.25, taken_at=at(2022, 1, 1) + 3 * k * 86_400_000) for k in range(40)]
    rows += [photo(f"near{k:02d}", lat=43.19, lon=140.99, taken_at=at(2023, 3, 4 + k // 12, 9 + k % 12)) for k in range(24)]
    near = AlbumOptions(timeline=TimelineOptions(far_meters=20_000.0))
    assert "小樽、1泊2日の旅" in {a.title for a in build_albums(frame(spark, rows), near).collect()}
    assert "trip" not in {a.kind for a in build_albums(frame(spark, rows)).collect()}


def test_folding_any_drafts(spark):
    drafts = [("t", "trip", "abcde"), ("s", "scene", "abcde"), ("p", "place", "abcde"), ("q", "place", "abcdef"), ("r", "day", "axyzw"), ("m", "monthly", "bcdefg")]
    rows = spark.createDataFrame([(1, d, k, len(ids)) for d, k, ids in drafts], "library_id long, draft string, kind string, n long")
    members = spark.createDataFrame([(1, d, x) for d, _, ids in drafts for x in ids], "library_id long, draft string, id string")
    # q is like t (5 of 6), m is like q (5 of 7: no); p is equal to t
    assert {r.draft for r in dropped_drafts(similar_pairs(rows, members)).collect()} == {"s", "p", "q"}
    chain = spark.createDataFrame([(1, a, b) for a, b in ("ab", "bc", "cd", "ad")], "library_id long, a string, b string")
    assert {r.draft for r in dropped_drafts(chain).collect()} == {"b", "d"}


def brute_fold(drafts, above=0.8):
    """Greedy folding of (name, kind, members) over all pairs; the names that go."""
    kept, gone = [], set()
    for name, _, ids in sorted(drafts, key=lambda d: (scalar.KINDS.index(d[1]), -len(d[2]), d[0])):
        if any(len(ids & other) > above * len(ids | other) for other in kept):
            gone.add(name)
        else:
            kept.append(ids)
    return gone


def draft_frames(spark, drafts):
    rows = spark.createDataFrame([(1, d, k, len(ids)) for d, k, ids in drafts], "library_id long, draft string, kind string, n long")
    return rows, spark.createDataFrame([(1, d, x) for d, _, ids in drafts for x in ids], "library_id long, draft string, id string")


def test_folding_arbitrary_drafts_equals_a_greedy_loop(spark):
    r, drafts = random.Random(9), []
    for k in range(40):
        base = {f"x{r.randrange(300)}" for _ in range(r.choice([1, 2, 5, 10, 30, 60]))} | {"hot"}
        for j in range(r.choice([1, 2, 4])):
            own = {x for x in base if r.random() > 0.08} | {f"y{k}{j}{i}" for i in range(r.choice([0, 0, 1, 3]))}
            drafts.append((f"d{k:02d}-{j}", r.choice(scalar.KINDS), own or {"hot"}))
    rows, members = draft_frames(spark, drafts)
    gone = {x.draft for x in folded_drafts(rows, members).collect()}
    assert gone == brute_fold(drafts) and 10 < len(gone) < len(drafts) - 20
    pairs = {frozenset((x.a, x.b)) for x in similar_pairs(rows, members).collect()}
    assert pairs == {frozenset((a[0], b[0])) for a, b in combinations(drafts, 2) if len(a[2] & b[2]) > 0.8 * len(a[2] | b[2])}


def test_a_photo_in_ten_thousand_drafts_makes_few_pairs(spark):
    many = [(f"d{k:05d}", "scene", {"hot", *(f"p{k}-{j}" for j in range(5))}) for k in range(10_000)]
    many += [("twin", "trip", {"hot", "p7-0", "p7-1", "p7-2", "p7-3", "p7-4"}), ("near", "place", {"hot", *(f"p9-{j}" for j in range(5)), "z"})]
    many += [(f"same{k:04d}", "device", {"hot", "a", "b"}) for k in range(1500)]  # a million pairs of equals
    rows, members = draft_frames(spark, many)
    assert {x.draft for x in folded_drafts(rows, members).collect()} == {"d00007", "d00009", *(f"same{k:04d}" for k in range(1, 1500))}
    distinct = rows.where("draft not like 'same%'")
    assert similar_pairs(distinct, members.where("draft not like 'same%'")).count() == 2


def test_empty_library(spark):
    assert build_albums(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bursts(spark):
    rows = [
        photo("a", taken_at=0, phash="ffffffff00000000"), photo("b", taken_at=500, phash="ffffffef00000000"), photo("c", taken_at=1000, phash="ffffffff00000001"),
        photo("d", taken_at=9_000_000, phash="00ff00ff00ff00ff"), photo("e", taken_at=12_600_000, phash="00ff00ff00ff00ff"),
        photo("f", taken_at=60_000_000, phash="0f0f0f0f0f0f0f0f", luma_variance=0.0001), photo("g", taken_at=60_000_100, phash="0f0f0f0f0f0f0f0f", luma_variance=0.0001),
    ]
    photos = frame(spark, rows)
    groups = bursts.burst_groups(photos, bursts.burst_members(photos)).orderBy("start").collect()
    assert [(g.n, g.subtype, g.burst) for g in groups] == [(3, "burst", "a"), (2, "dup", "d")]


def brute_bursts(rows):
    """Groups of two or more, by union-find over all pairs."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        (l1, _, t1, b1), (l2, _, t2, b2) = rows[x], rows[y]
        far = (b1 ^ b2).bit_count()
        if l1 == l2 and (far <= 5 or far <= 10 and t1 is not None and t2 is not None and abs(t1 - t2) <= 3000):
            parent[root(x)] = root(y)
    groups = {}
    for k, (library, id, _, _) in enumerate(rows):
        groups.setdefault((library, root(k)), []).append(id)
    return {(library, id, min(ids)) for (library, _), ids in groups.items() if len(ids) > 1 for id in ids}


@pytest.mark.parametrize("small", [False, True])
def test_burst_members_equal_all_pairs(spark, monkeypatch, small):
    if small:  # blocks, and pieces of crowded moments
        for name, value in (("LIGHT", 3), ("BLOCK", 7), ("CROWD", 12)):
            monkeypatch.setattr(bursts, name, value)
    r = random.Random(12)
    centres, rows = [r.getrandbits(64) for _ in range(12)], []
    for k in range(500):
        bits = r.choice(centres)
        for _ in range(r.choice([0, 2, 4, 5, 9])):
            bits ^= 1 << r.randrange(64)
        moment = r.choice([None, 0, 2_999, 3_000, 5_999, 6_000, r.randrange(40_000), r.randrange(40_000)])
        rows.append((k % 2, f"p{k:03d}", moment, bits))
    df = frame(spark, [(library, *photo(id, taken_at=t, phash=f"{b:016x}")[1:]) for library, id, t, b in rows]).repartition(4)
    assert {tuple(x) for x in bursts.burst_members(df).collect()} == brute_bursts(rows)


def test_a_moment_with_very_many_photos_makes_few_links(spark):
    """An import that has only days for times: 100,000 photos of one moment with five hashes, and 3,000 that all differ a little."""
    one = photo("x", taken_at=0)
    base = frame(spark, [one])
    names = [n for n in NAMES if n not in ("id", "phash", "library_id")]
    hashes = F.array(*map(F.lit, ("0123456789abcdef", "0123456789abcdee", "0123456789ab0def", "fedcba9876543210", "00ff00ff00ff00ff")))
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("library_id"), F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.element_at(hashes, (F.col("id") % 5 + 1).cast("int")).alias("phash"))
    bits = F.lit(0x0F0F0F0F0F0F0F0F).bitwiseXOR(F.expr("shiftleft(1L, cast(id % 60 as int))")).bitwiseXOR(F.expr("shiftleft(1L, cast(id div 60 as int))"))
    near = spark.range(3000).select(F.lit(2).cast("long").alias("library_id"), F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lower(F.lpad(F.hex(bits), 16, "0")).alias("phash"))
    rows = many.unionByName(near).crossJoin(F.broadcast(base.select(*names))).select(*NAMES)
    held, links = bursts.burst_links(rows)
    assert held.where("library_id = 1").count() == 5 and links.where("library_id = 1").count() <= 50
    distinct = held.where("library_id = 2").count()
    assert distinct > 1000 and links.where("library_id = 2").count() <= 25 * distinct  # a forest for each key, where all pairs would be some 10^6
    members = bursts.burst_members(rows)
    # of a hash's 20,000 copies each is in its group; two of the five differ by one bit, and one more by four, in one moment
    assert {(x.library_id, x.burst, x["count"]) for x in members.groupBy("library_id", "burst").count().collect()} == {(1, "p000000", 60_000), (1, "p000003", 20_000), (1, "p000004", 20_000), (2, "q000000", 3000)}
    assert {(x.burst, x.n, x.subtype) for x in bursts.burst_groups(rows, members).where("library_id = 1").collect()} == {("p000000", 60_000, "burst"), ("p000003", 20_000, "burst"), ("p000004", 20_000, "burst")}


def test_gaps_across_slices(spark):
    hour = 3_600_000
    times = {"a": [hour - 1500, hour - 100, hour + 1200], "b": [hour - 1500, hour - 100, hour + 3000], "c": [0, 0, 0, None], "d": [5 * hour - 2900, 5 * hour, 5 * hour + 2900, 5 * hour + 5800], "e": [0, hour], "f": [0, 0, 7 * hour], "g": [None] * 3, "h": [-hour - 1, -hour + 2, -hour + 4]}
    rows = [photo(f"{g}{k}", taken_at=t, phash=f"{ord(g) * 0x0101010101010101 & (1 << 64) - 1:016x}") for g, own in times.items() for k, t in enumerate(own)]
    df = frame(spark, rows)
    members = spark.createDataFrame([(1, x[1], x[1][0]) for x in rows], "library_id long, id string, burst string")
    found = {x.burst: (x.n, x.start, x.end, x.subtype) for x in bursts.burst_groups(df, members).collect()}
    for g, own in times.items():
        known = sorted(t for t in own if t is not None)
        whole = len(known) == len(own) >= 3 and all(y - x <= 3000 for x, y in zip(known, known[1:]))
        assert found[g] == (len(own), min(known, default=None), max(known, default=None), "burst" if whole else "dup")


def test_timeline(spark):
    rows = [photo(f"t{i:02d}", taken_at=at(2026, 7, 10 + i // 12, 9 + i % 12), lat=34.69, lon=135.5) for i in range(24)]
    rows += [photo("m1", taken_at=at(2026, 8, 1, 23, 50)), photo("m2", taken_at=at(2026, 8, 2, 0, 20))]
    homes = spark.createDataFrame([(1, 35.68, 139.76)], "library_id long, home_lat double, home_lon double")
    events, members = tl.timeline(frame(spark, rows), homes)
    assert [(e.event_kind, e.n_days, e.nights, e.n_counted) for e in events.orderBy("event").collect()] == [("trip", 2, 1, 24), ("day", 1, 0, 2)]
    assert members.count() == 26
    near = spark.createDataFrame([(1, 34.69, 135.5)], "library_id long, home_lat double, home_lon double")
    assert {e.event_kind for e in tl.timeline(frame(spark, rows), near)[0].collect()} == {"day"}


def test_places_and_noise(spark):
    rows = [photo(f"k{i}", lat=35.0116 + i * 1e-4, lon=135.7681) for i in range(3)] + [photo(f"y{i}", lat=35.6812, lon=139.7671) for i in range(3)] + [photo("z", lat=40, lon=140)]
    rows += [photo(f"w{i}", lat=0.001 * i, lon=179.999 if i % 2 else -179.999) for i in range(3)]
    got = {(r.id, r.place) for r in places.place_members(frame(spark, rows)).collect()}
    assert got == {(f"k{i}", "k0") for i in range(3)} | {(f"y{i}", "y0") for i in range(3)} | {(f"w{i}", "w0") for i in range(3)}


def test_dbscan_by_another_distance(spark):
    points = [(1, k, float(x), float(y), 1) for k, (x, y) in enumerate([(5, 5), (6, 5), (5, 6), (6, 6), (90, 90), (91, 90), (90, 91), (40, 40), (8, 6)])]
    df = spark.createDataFrame(points, "library_id long, point long, x double, y double, weight long")

    def in_reach(p):
        other = p.select("library_id", F.col("point").alias("point2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("weight").alias("weight2"))
        return p.join(other, "library_id").where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= 2).select("library_id", "point", "point2", "weight2")

    assert {(r.point, r.cluster) for r in places.dbscan(df, in_reach, 3).collect()} == {(k, 0) for k in (0, 1, 2, 3, 8)} | {(k, 4) for k in (4, 5, 6)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("kind", ["plane", "bits", "words"])
def test_metric_clusters_equal_dbscan_of_all_pairs(spark, kind):
    r = random.Random(10)
    if kind == "plane":
        rows = [(k % 2, k, r.choice([0, 50, 55, 200, 400]) + r.gauss(0, 4), r.choice([0, 80, 300]) + r.gauss(0, 4), 1 + k % 2) for k in range(500)]
        schema, reach, plain = "library_id long, point long, x double, y double, weight long", 3.0, lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
        metric = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    elif kind == "bits":
        centres = [r.getrandbits(64) for _ in range(20)]
        rows = [(k % 2, k, r.choice(centres) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), 1) for k in range(400)]
        rows = [(l, k, b - (1 << 64) if b >> 63 else b, w) for l, k, b, w in rows]
        schema, reach, plain = "library_id long, point long, bits long, weight long", 5, lambda a, b: ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count()
        metric = lambda a, b: F.bit_count(a["bits"].bitwiseXOR(b["bits"]))
    else:
        bases = ["IMG_2041.jpg", "DSC00317.png", "holiday-paris", "birthday", "scan"]
        rows = [(1, k, "".join(c if r.random() > 0.12 else r.choice("xyz0") for c in r.choice(bases)) + r.choice(["", "", "a"]), 1 + k % 3) for k in range(250)]
        schema, reach, plain = "library_id long, point long, name string, weight long", 2, lambda a, b: edit_distance(a[2], b[2])
        metric = lambda a, b: F.levenshtein(a["name"], b["name"])
    df, tried = spark.createDataFrame(rows, schema), []
    near = {(a[0], a[1], b[1], b[-1]) for a in rows for b in rows if a[0] == b[0] and plain(a, b) <= reach}
    found = [tuple(x) for x in metric_pairs(df, metric, reach, tried=tried).collect()]
    assert len(found) == len(set(found)) and set(found) == near
    every = sum(a[0] == b[0] for a in rows for b in rows)
    assert tried[1] <= tried[0] and tried[1] < {"plane": 0.1, "bits": 0.25, "words": 0.6}[kind] * every  # what the metric is asked for

    def all_pairs(p):
        other = p.select("library_id", *(F.col(c).alias(f"{c}2") for c in p.columns if c != "library_id"))
        return p.join(other, "library_id").where(metric(F.struct(*(F.col(c) for c in p.columns)), F.struct(*(F.col(f"{c}2").alias(c) for c in p.columns if c != "library_id"))) <= reach).select("library_id", "point", "point2", "weight2")

    clusters = {tuple(x) for x in metric_clusters(df, metric, reach, 4).collect()}
    assert clusters == {tuple(x) for x in places.dbscan(df, all_pairs, 4).collect()} and len({c[::2] for c in clusters}) >= 3


def test_near_clusters_equal_dbscan_of_all_pairs(spark):
    r = random.Random(3)
    rows = []
    for library, (lat, lon) in enumerate([(35.0, 139.0), (0.0, 179.999), (-70.0, 10.0), (89.9, 0.0), (60.0, -180.0)]):
        for k in range(250):
            far = 0.02 if k % 2 else 0.004
            x = lon + r.uniform(-far, far) / max(0.01, math.cos(math.radians(lat)))
            rows.append((library, k, max(-90.0, min(90.0, lat + r.uniform(-far, far)))  if k % 7 else lat, (x + 180) % 360 - 180, 1 + k % 2))
    df = spark.createDataFrame(rows, "library_id long, point long, lat double, lon double, weight long")
    for meters, least in ((500.0, 3), (150.0, 4), (60.0, 3)):
        whole = {tuple(x) for x in places.dbscan(df, lambda p: places.near_pairs(p, meters), least).select("library_id", "point", "cluster").collect()}
        assert {tuple(x) for x in places.near_clusters(df, meters, least).select("library_id", "point", "cluster").collect()} == whole and len({c[::2] for c in whole}) > 5


def test_crowds_side_by_side_are_told_apart_by_few_pairs(spark):
    def crowd(mark, lat, lon, step):
        return spark.range(22_500).select(F.lit(1).alias("library_id"), F.lit(mark).alias("mark"), (lat + F.col("id") % 150 * step).alias("lat"), (lon + F.floor(F.col("id") / 150) * step).alias("lon"), F.lit(1).alias("weight"))

    step, east = 1e-5, 0.0015 + 500 / (111_194.9 * math.cos(math.radians(35.0)))
    points = crowd("a", 35.0, 139.0, step).unionByName(crowd("b", 35.0, 139.0 + east - 2e-5, step)).unionByName(crowd("c", 35.0, 139.0 - east - 3e-5, step)).unionByName(crowd("d", 35.001, 139.0005, step))
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "a", "d"), (1, "b", "c")], "library_id int, mark string, mark2 string")
    made = []
    assert {(x.mark, x.mark2) for x in places.touching(pairs, points, 500.0, made).collect()} == {("a", "b"), ("a", "d")}
    assert sum(made) < 0.02 * 2 * 22_500**2


def test_a_crowded_place_makes_few_pairs(spark):
    df = spark.range(20_000).select(F.lit(1).alias("library_id"), F.col("id").alias("point"), (35 + F.col("id") % 200 * 1e-6).alias("lat"), (139 + F.floor(F.col("id") / 200) * 1e-6).alias("lon"), F.lit(1).alias("weight"))
    assert {r.cluster for r in places.near_clusters(df, 500.0, 3).select("cluster").distinct().collect()} == {0}
    full = places._fine_cells(df, 500.0).groupBy("cell").count()
    assert full.count() <= 4  # no sparse points, so only their quarters meet


@pytest.mark.parametrize("few", [256, 4])
def test_counted_pairs_equal_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW", few)
    r = random.Random(8)
    rows = []
    for library, (lat, lon) in enumerate([(35.0, 139.0), (0.0, 179.999), (-70.0, 10.0), (89.995, 0.0), (60.0, -180.0)]):
        for k in range(160):
            far = 0.02 if k % 2 else 0.004
            x = lon + r.uniform(-far, far) / max(0.01, math.cos(math.radians(lat)))
            rows.append((library, max(-90.0, min(90.0, lat + r.uniform(-far, far))) if k % 7 else lat, (x + 180) % 360 - 180, 1 + k % 3))

    def far_apart(a, b):
        (_, y1, x1, _), (_, y2, x2, _) = a, b
        s, t = (math.sin(math.radians(d) / 2) for d in (y2 - y1, x2 - x1))
        return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(s * s + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * t * t)))

    df = spark.createDataFrame(rows, "library_id long, lat double, lon double, weight long")
    for meters in (500.0, 120.0):
        found = {tuple(x) for x in counts.pairs_within(df, meters).collect()}
        assert found == {(k, sum(a[3] * b[3] for a in rows for b in rows if a[0] == b[0] == k and far_apart(a, b) <= meters)) for k in range(5)}
    assert counts.pairs_within(df.where("lat > 100"), 500.0).count() == 0


def test_a_crowd_is_counted_with_few_pairs(spark):
    def grid(step):
        return spark.range(40_000).select(F.lit(1).alias("library_id"), (35 + F.col("id") % 200 * step).alias("lat"), (139 + F.floor(F.col("id") / 200) * step).alias("lon"), F.lit(2).alias("weight"))

    made = []
    assert [tuple(x) for x in counts.pairs_within(grid(1e-6), 500.0, made).collect()] == [(1, 80_000**2)] and sum(made) <= 20
    made.clear()
    n = counts.pairs_within(grid(5e-5), 500.0, made).first().n_pairs  # a square kilometer
    assert 0.3 * 80_000**2 < n < 0.8 * 80_000**2 and sum(made) < 0.05 * 40_000**2


@pytest.mark.parametrize("n", [0, 1, 3000, 100_000])
def test_nearest_entry_of_a_table_of_any_size(spark, n):
    r = np.random.default_rng(13)
    lat = np.where(np.arange(n) % 3 == 0, np.degrees(np.arcsin(r.uniform(-1, 1, n))), 35 + r.normal(0, 0.3, n))
    lon = np.where(np.arange(n) % 3 == 0, r.uniform(-180, 180, n), 139 + r.normal(0, 0.3, n))
    entries = [(k, f"e{k}", float(y), float(x)) for k, (y, x) in enumerate(zip(lat, lon))] + [(-1, "nowhere", None, 1.0)] + ([(n + 5, "twin", float(lat[0]), float(lon[0]))] if n else [])
    asks = [(k, float(y), float(x)) for k, (y, x) in enumerate([(90, 0), (-90, 12), (0, 180), (0, -180), (35, 139), (89.99, -179.9), *zip(35 + r.normal(0, 0.5, 200), 139 + r.normal(0, 0.5, 200)), *zip(r.uniform(-90, 90, 100), r.uniform(-180, 180, 100))])]
    asks += [(1000, float(lat[0]), float(lon[0]))] if n else []
    rows = spark.createDataFrame([*asks, (1001, None, 3.0), (1002, 3.0, None)], "id long, lat double, lon double")
    table = spark.createDataFrame(pd.DataFrame(entries, columns=["ord", "name", "lat", "lon"]).astype({"lat": float, "lon": float})).withColumn("lat", F.when(~F.isnan("lat"), F.col("lat")))
    got = {x.id: x.near for x in with_nearest_entry(rows, table).collect()}
    assert len(got) == len(asks) + 2 and got[1001] is None and got[1002] is None
    if not n:
        assert set(got.values()) == {None}
        return
    for id, y, x in asks:
        s, t = np.sin(np.radians(lat - y) / 2), np.sin(np.radians(lon - x) / 2)
        far = 2 * 6_371_000.0 * np.arcsin(np.minimum(1, np.sqrt(s * s + np.cos(np.radians(y)) * np.cos(np.radians(lat)) * t * t)))
        assert abs(got[id].meters - far.min()) < 1e-6 and far[got[id].ord] <= far.min() + 1e-6
    assert got[1000].ord == 0


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (None, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = {tuple(x) for x in components(df).collect()}
    assert few == set(stars_of([(a, b) for a, b in edges if a is not None])) | {(b, b) for _, b in stars_of([(a, b) for a, b in edges if a is not None])}
    components_module.CHUNK, held = 20, components_module.CHUNK
    try:
        assert {tuple(x) for x in components(df.repartition(7)).collect()} == few
    finally:
        components_module.CHUNK = held
    named = components(spark.createDataFrame([((1, "b"), (1, "ä")), ((1, "ä"), (1, "a")), ((2, "b"), (2, "z"))], "a struct<l:long,s:string>, b struct<l:long,s:string>"))
    assert {(tuple(x.node), tuple(x.component)) for x in named.collect()} == {((1, s), (1, "a")) for s in ("a", "b", "ä")} | {((2, s), (2, "b")) for s in "bz"}


def test_home_needs_three_photos(spark):
    rows = [photo(f"h{i}", lat=35.0, lon=139.0) for i in range(2)]
    assert infer_home(frame(spark, rows)).count() == 0
    assert infer_home(frame(spark, [*rows, photo("h2", lat=35.0, lon=139.0)])).first().home_lat == 35.0


@pytest.mark.parametrize(
    ("label", "own"),
    [
        ("スクショ", {"name": "scre shot.png"}), ("夜景", {"brightness": 0.1}), ("夕焼け", {"top_hex": "#e08040", "warmth": 0.2, "colorfulness": 40.0, "aspect": 1.5}), ("青空", {"blue_top_ratio": 0.5, "brightness": 0.7, "edge_density": 0.1}),
        ("みどり", {"green_ratio": 0.5, "saturation": 0.4}), ("グルメ", {"warmth": 0.1, "saturation": 0.5, "colorfulness": 50.0, "aspect": 1.0}), ("モノクロ", {"saturation": 0.05}), ("人物", {"aspect": 0.75, "top_hex": "#e0a080"}), ("あたたかい色", {"warmth": 0.16, "aspect": 1.0}),
        ("いろいろ", {"name": "Screenshot_1.png"}),
    ],
)
def test_scenes(spark, label, own):
    assert classify(frame(spark, [photo("p", **own)])).first().scene == label


def test_scalars(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    s = F.lit
    assert [one(scalar.hamming(s(a), s(b))) for a, b in (("0" * 16, "f" * 16), ("0" * 16, "0" * 15 + "1"), ("0000000100000003", "0" * 16), ("abc", "0" * 16))] == [64, 1, 3, 64]
    assert 390_000 < one(scalar.haversine(s(35.6812), s(139.7671), s(34.7025), s(135.4959))) < 415_000
    assert 20_000 < one(scalar.haversine(s(0.0), s(179.9), s(0.0), s(-179.9))) < 24_000
    assert [one(scalar.valid_gps(s(a), s(b))) for a, b in ((0.0, 0.0), (91.0, 0.0), (0.0, 181.0), (float("nan"), 0.0), (35.0, 139.0))] == [False] * 4 + [True]
    assert one(scalar.array_jaccard(F.array(*map(s, "abc")), F.array(*map(s, "bcd")))) == 0.5
    assert one(scalar.round_half_up(s(-2.5))) == -2
    assert one(scalar.rgb_hex(s(255), s(0), s(128))) == "#ff0080"
    assert [one(scalar.album_priority(s(k))) for k in ("trip", "monthly")] == [0, 7]


@pytest.mark.parametrize(
    ("day", "name"),
    [
        ((2017, 12, 23), "天皇誕生日"), ((2019, 12, 23), None), ((2023, 2, 23), "天皇誕生日"), ((2015, 8, 11), None), ((2016, 8, 11), "山の日"), ((2019, 10, 14), "体育の日"), ((2022, 10, 10), "スポーツの日"),
        ((2024, 7, 15), "海の日"), ((2020, 9, 22), "秋分の日"), ((2020, 9, 23), None), ((2025, 9, 23), "秋分の日"), ((2023, 3, 21), "春分の日"), ((2023, 3, 20), None), ((2024, 3, 20), "春分の日"), ((2026, 1, 12), "成人の日"),
    ],
)
def test_holidays(spark, day, name):
    assert spark.range(1).select(naming.holiday(F.lit(at(*day))).alias("x")).first().x == name


def test_one_decimal_rounds_the_exact_value(spark):
    rows = spark.createDataFrame([(0.35,), (0.25,), (1.2,), (None,)], "x double").select(naming.one_decimal("x").alias("y")).collect()
    assert [r.y for r in rows] == ["0.3", "0.3", "1.2", None]


def test_pieces_of_hashes_are_not_sent_to_the_driver(spark, tmp_path):
    frame(spark, [photo("a"), photo("b")]).write.parquet(f"{tmp_path}/photos")
    links = bursts.dup_edges(spark.read.parquet(f"{tmp_path}/photos"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[library_id#\d+L?, pair#\d+, value#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[library_id#\d+L?, pair", plan)


def test_hues_at_the_edges_are_told_exactly(spark):
    yellow = [(r, b + 3 * (r - b) // 4, b) for r in range(0, 256, 3) for b in range(0, r, 5) if (r - b) % 4 == 0]
    purple = [(r, g, g + (r - g) // 2) for r in range(0, 256, 3) for g in range(0, r, 5) if (r - g) % 2 == 0]
    rows = [("#%02x%02x%02x" % x, True) for x in yellow + purple] + [("#%02x%02x%02x" % x, False) for x in [(r, g + 1, b) for r, g, b in yellow] + [(r, g, b + 1) for r, g, b in purple]]
    told = spark.createDataFrame(rows, "top_hex string, warm boolean").withColumn("found", warm_hue(F.col("top_hex")))
    assert told.where("found <> warm").collect() == []


def test_the_nearest_place_is_found_in_tasks(spark):
    rows = places.with_nearest(spark.createDataFrame([(1, 35.6586, 139.7454), (2, None, 3.0)], "id long, lat double, lon double"), "lat", "lon")
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    assert {x.id: x.near and x.near.name for x in rows.collect()} == {1: "東京タワー", 2: None}


def test_lists_of_near_entries_stay_short_where_entries_are_dense(spark, monkeypatch):
    entries = [(k, f"e{k}", 35 + k % 40 * 1e-4, 139 + k // 40 * 1e-4) for k in range(1600)]
    asks = spark.createDataFrame([(1, 35.00201, 139.00201)], "id long, lat double, lon double")
    held = []
    monkeypatch.setattr(nearest, "shared_checkpoint", lambda df: held.append(df) or shared_checkpoint(df))
    found = with_nearest_entry(asks, spark.createDataFrame(entries, "ord long, name string, lat double, lon double"))
    assert found.first().near.name == "e820"
    assert held[-1].select(F.max(F.size("__entries"))).first()[0] <= nearest.FEW


def test_small_libraries_of_hashes_make_no_row_for_each_piece(spark, monkeypatch):
    asked = []
    whole = bursts._links
    monkeypatch.setattr(bursts, "_links", lambda rows, keys, *more: asked.append((keys, rows.count())) or whole(rows, keys, *more))
    bursts.burst_links(frame(spark, [photo(f"p{k}", phash=f"{k * 2654435761:016x}") for k in range(50)]))
    assert asked[0] == ((), 50)


def test_points_of_small_libraries_meet_without_pivots(spark):
    """each hash was posted at nearly all pivots, in three rings, with its distances from all of them."""
    r = random.Random(4)
    rows = [(k % 8 if k < 800 else 9, k, r.getrandbits(3) << 20 | r.getrandbits(2), 1 + k % 2) for k in range(940)]
    df = spark.createDataFrame(rows, "library_id long, point long, bits long, weight long")

    def met(p):
        return metric_pairs(p, lambda a, b: F.bit_count(a["bits"].bitwiseXOR(b["bits"])), 2)

    assert sorted(map(tuple, met(df).collect())) == sorted((a[0], a[1], b[1], b[3]) for a in rows for b in rows if a[0] == b[0] and (a[2] ^ b[2]).bit_count() <= 2)
    assert "Generate" not in met(df.where("library_id < 8"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("chunk", [20, 45])
def test_components_of_groups_are_contracted_once(spark, monkeypatch, chunk):
    """Links of one library are one chunk, whatever task they came from; only libraries with more go through rounds."""
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    r = random.Random(6)
    links = [(lib, r.randrange(30), r.randrange(30)) for lib in range(40) for _ in range(12)] + [(99, k, k + 1) for k in range(60)]
    df = spark.createDataFrame([((lib, f"x{a:02d}"), (lib, f"x{b:02d}")) for lib, a, b in links], "a struct<l:long,s:string>, b struct<l:long,s:string>").repartition(7)
    known = {((lib, f"x{a:02d}"), (lib, f"x{b:02d}")) for lib, a, b in links}
    stars = stars_of(list(known))
    rounds = []
    held = components_module._print_of
    monkeypatch.setattr(components_module, "_print_of", lambda rows: rounds.append({x.a.l for x in rows.collect()}) or held(rows))
    found = {(tuple(x.node), tuple(x.component)) for x in components(df, "l").collect()}
    assert found == set(stars) | {(b, b) for _, b in stars}
    assert rounds and all(r == {99} for r in rounds)


def test_nodes_are_ordered_as_spark_does(spark):
    values = [(None, 1.5, False), ("a", float("nan"), True), ("a", float("inf"), True), ("ä", None, True), ("z", -1.0, None), ("😀", 0.0, True), ("￿", 0.0, True), ("", 2.0, True)]
    df = spark.createDataFrame([(a, b) for a, b in zip(values, values[1:])], "a struct<s:string,d:double,t:boolean>, b struct<s:string,d:double,t:boolean>")
    least = df.select(F.explode(F.array("a", "b")).alias("n")).agg(F.min("n")).first()[0]
    assert {x.component for x in components(df).collect()} == {least} and components(df).count() == len(values)


def test_shared_steps_are_worked_out_once(spark):
    """F12, F6, F7, F8: sessions, days and drafts were worked out again by each step that reads them."""
    photos = demo_photos(spark)
    events, members = tl.timeline(photos, infer_home(photos))
    assert all("Window" not in df._jdf.queryExecution().toString() for df in (events, members))
    assert all("Generate" not in df._jdf.queryExecution().toString() for df in plan_albums(photos))


def test_labels_are_compiled(spark):
    """F6, F7, F8, F12: the JVM leaves methods of more than 8,000 bytes to its interpreter."""
    from lumenfold.functions.scene import labelled
    from lumenfold.sources.events import read_photos

    plan = labelled(read_photos(spark, "/root/testdata/sf0.001")).select("library_id", "id", "phash", "brightness", "label")._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) <= 8000


def test_pairs_told_by_photo_equal_those_that_meet(spark):
    r = random.Random(16)
    base = {k: {f"{k}-{i}" for i in range(r.randrange(3, 30))} for k in range(40)}
    drafts = [(1 + k % 2, f"{kind}:{k}", kind, {x for x in ids if r.random() < r.choice([0.7, 0.95, 1])} or set(ids)) for k, ids in base.items() for kind in ("trip", "place", "scene", "device") if r.random() < 0.8]
    rows = spark.createDataFrame([(library, d, kind, len(ids)) for library, d, kind, ids in drafts], "library_id long, draft string, kind string, n long")
    members = spark.createDataFrame([(library, d, kind, len(ids), x) for library, d, kind, ids in drafts for x in ids], "library_id long, draft string, kind string, n long, id string").repartition(3)
    own = {(x.library_id, x.a, x.b) for x in similar_by_photo(members).collect()}
    assert own == {(x.library_id, x.a, x.b) for x in similar_pairs(rows, members.drop("kind", "n")).collect()} and len(own) > 20
    assert {(x.library_id, x.draft) for x in dropped_drafts(similar_by_photo(members)).collect()} == {(x.library_id, x.draft) for x in folded_drafts(rows, members.select("library_id", "draft", "id")).collect()}


def test_albums_move_few_bytes_for_each_photo(spark):
    """photos of drafts were moved ten times to fold drafts, and times were decimals. Counted: bytes that all tasks write to shuffles."""
    from lumenfold.sources.events import read_photos

    def written():
        time.sleep(1)  # figures come late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    photos = read_photos(spark, "/root/testdata/sf0.01")
    assert dict(photos.dtypes)["taken_at"] == "bigint"
    before = written()
    members = plan_albums(photos)[1]
    n = photos.count()
    members.write.format("noop").mode("overwrite").save()
    assert (written() - before) / n < 900  # 1,246 before, 639 after
