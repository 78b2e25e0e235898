import math
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
from photos import SCHEMA, at, frame, photo
from pyspark.sql import functions as F

from lumenfold.functions import exif, pixels
from lumenfold.functions import png as png_file
from lumenfold.operators import timeline as tl
from lumenfold.sources.events import wall_millis
from lumenfold.sources import files, images
from lumenfold.sources.images import read_images, scan_images, skipped
from lumenfold.options import TimelineOptions
from lumenfold.streaming.sessions import stream_sessions
from lumenfold.streaming.trips import joined, stream_trips


def png(rgb):
    h, w, _ = rgb.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg(order, taken=b"2024:05:06 07:08:09\0", lat=(35, 40, 52), lon=(139, 46, 2), refs=(b"N", b"E")):
    """The head of a JPEG file with EXIF."""

    def directory(base, entries):
        out, extra, end = struct.pack(order + "H", len(entries)), b"", base + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            if len(value) > 4:
                out += struct.pack(order + "HHII", tag, kind, count, end + len(extra))
                extra += value
            else:
                out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        return out + b"\0\0\0\0" + extra

    def ratios(*values):
        return b"".join(struct.pack(order + "II", v, 1) for v in values)

    own = [(0x9003, 2, len(taken), taken), (0x829D, 5, 1, struct.pack(order + "II", 18, 10)), (0x8827, 3, 1, struct.pack(order + "H", 400))]
    gps = [(1, 2, 2, refs[0] + b"\0"), (2, 5, 3, ratios(*lat)), (3, 2, 2, refs[1] + b"\0"), (4, 5, 3, ratios(*lon))]
    head = [(0x010F, 2, 6, b"Canon\0"), (0x8769, 4, 1, struct.pack(order + "I", 200)), (0x8825, 4, 1, struct.pack(order + "I", 400))]
    tiff = ((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + directory(8, head)).ljust(200, b"\0") + directory(200, own).ljust(200, b"\0") + directory(400, gps)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_exif_round_trip_in_both_byte_orders():
    tokyo = exif.parse_exif(jpeg(">"))
    assert (tokyo["taken_at"], tokyo["make"], tokyo["f_number"], tokyo["iso"]) == (at(2024, 5, 6, 7, 8, 9), "Canon", 1.8, 400)
    assert abs(tokyo["lat"] - 35.6811) < 1e-3 and abs(tokyo["lon"] - 139.7672) < 1e-3
    sydney = exif.parse_exif(jpeg("<", lat=(33, 51, 0), refs=(b"S", b"E")))
    assert sydney["lat"] == -33.85


def test_exif_never_raises():
    whole, r = jpeg("<"), random.Random(1)
    for cut in range(len(whole)):
        exif.parse_exif(whole[:cut])
    for _ in range(300):
        data = bytearray(whole)
        for _ in range(8):
            data[r.randrange(2, len(data))] = r.randrange(256)
        exif.parse_exif(bytes(data))
    assert set(exif.parse_exif(None).values()) == {None} == set(exif.parse_exif(b"\x89PNG....").values())


def test_exif_times_carry_over():
    assert exif.exif_time("2025:13:01 00:00:00") == at(2026, 1, 1, 0)
    assert exif.exif_time("2025:02:30 24:00:00") == at(2025, 3, 3, 0)
    assert exif.exif_time("0000:01:01 00:00:00") is None and exif.exif_time("0050:01:01 00:00:00") == at(1950, 1, 1, 0)


def features(*rasters, seeds=(1,)):
    return pixels.features(np.stack(rasters), list(seeds))


def test_pixel_features():
    grid = np.zeros((64, 64, 3))
    grid[:32], grid[32:] = (90, 150, 230), (60, 150, 60)
    both = features(grid, np.full((64, 64, 3), 128.0), seeds=(42, 1))
    f, flat = ({name: values[k] for name, values in both.items()} for k in (0, 1))
    assert f["blue_top_ratio"] == 1 and abs(f["green_ratio"] - 0.5) < 1e-9 and f["top_weights"][:2] == [0.5, 0.5] and set(f["top_hexes"][:2]) == {"#5a96e6", "#3c963c"}
    assert flat["contrast"] < 1e-9 and flat["edge_density"] == 0 and flat["colorfulness"] < 1e-9 and abs(flat["brightness"] - 128 / 255) < 1e-9
    noise = np.random.default_rng(2).integers(0, 256, (64, 64, 3)).astype(float)
    near = np.clip(noise + 3, 0, 255)
    a, b, c = pixels.phash(pixels.luma(np.stack([noise, near, noise[::-1]])))
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 6 < bin(int(a, 16) ^ int(c, 16)).count("1") and len(pixels.ahash(pixels.luma(noise[None]))[0]) == 16


def slow_phash(gray):
    """64 bits by sums in plain Python: cosine coefficients of 32 x 32 means, over the median of all but the first."""
    cells = [[sum(gray[2 * y + a][2 * x + b] for a in (0, 1) for b in (0, 1)) / 4 for x in range(32)] for y in range(32)]
    cos = [[math.cos((2 * n + 1) * k * math.pi / 64) for n in range(32)] for k in range(8)]
    rows = [[sum(cells[y][x] * cos[v][x] for x in range(32)) for v in range(8)] for y in range(32)]
    values = [sum(rows[y][v] * cos[u][y] for y in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(values[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in values), 2):016x}"


def slow_colors(points, rgb, seed, k=5, rounds=10):
    """Main colours by plain loops over points of the Lab space."""
    numbers, chosen = pixels.mulberry32(seed), []
    while len(chosen) < k:
        at = int(next(numbers) * len(points))
        while at in chosen:
            at = (at + 1) % len(points)
        chosen.append(at)
    centres, own = [points[c] for c in chosen], [0] * len(points)
    for turn in range(rounds):
        nearest = [min(range(k), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centres[c])), c)) for p in points]
        moved, own = nearest != own, nearest
        for c in range(k):
            held = [p for p, o in zip(points, own) if o == c]
            centres[c] = tuple(math.fsum(x) / len(held) for x in zip(*held)) if held else centres[c]
        if turn and not moved:
            break
    order = sorted(range(k), key=lambda c: (-own.count(c), c))[:3]
    return ["#" + "".join(f"{int(sum(x) / own.count(c) + 0.5):02x}" for x in zip(*(v for v, o in zip(rgb, own) if o == c))) for c in order if own.count(c)], [own.count(c) / len(own) for c in order if own.count(c)]


def test_hash_and_main_colors_equal_slow_versions():
    noise = np.random.default_rng(3).integers(0, 256, (6, 64, 64, 3)).astype(float)
    assert pixels.phash(pixels.luma(noise)) == [slow_phash(x) for x in pixels.luma(noise).tolist()]
    small = noise[:, :12, :12].copy()
    small[3] = small[3, 0, 0]  # one colour: clusters without pixels
    small[4] = np.where(np.arange(12)[None, :, None] < 7, small[4, 0, 0], small[4, 1, 1])
    seeds = [1, 7, 8, 9, 10, 11]
    hexes, shares = pixels.main_colors(small, seeds)
    for k, seed in enumerate(seeds):
        assert (hexes[k], shares[k]) == slow_colors([tuple(p) for p in pixels.lab(small[k]).reshape(-1, 3).tolist()], small[k].reshape(-1, 3).astype(int).tolist(), seed)


def test_stacks_give_what_single_rasters_give(spark):
    r = np.random.default_rng(4)
    stack = r.integers(0, 256, (40, 64, 64, 3)).astype(np.uint8)
    stack[20:] = stack[20:] // 100 * 100  # few colours, so that clusters come to rest early
    together = pixels.features(stack, list(range(40)))
    for k in range(40):
        assert all(values[0] == together[name][k] for name, values in pixels.features(stack[[k]], [k]).items())
    # rasters of several sizes, and none, in one batch
    rows = [(k, None if k == 3 else b"" if k == 4 else np.dstack([stack[k, :side, :side], np.full((side, side), 255, np.uint8)]).tobytes(), side) for k in range(8) for side in (16 if k % 2 else 64,)]
    df = spark.createDataFrame(rows, "id long, rgba binary, side int").select("id", pixels.pixel_features("rgba", "side", "side", "id").alias("px"))
    got = {x.id: x.px for x in df.collect()}
    for k, data, side in rows:
        if not data:
            assert got[k] is None or got[k].phash is None
        else:
            one = pixels.features(stack[k : k + 1, :side, :side], [k])
            assert all(got[k][name] == (values[0] if isinstance(values, list) else float(values[0])) for name, values in one.items())


def test_seeded_numbers():
    numbers = pixels.mulberry32(42)
    assert [round(next(numbers), 6) for _ in range(2)] == [0.601104, 0.448291]
    assert pixels.fnv1a("") == 0x811C9DC5 and pixels.fnv1a("a") == 0xE40C292C


def test_images_become_photos(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.full((80, 120, 3), (200, 30, 30))))
    (tmp_path / "b.jpg").write_bytes(jpeg(">"))
    (tmp_path / "notes.txt").write_text("no image")
    rows = {r["name"]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.png", "b.jpg"} and rows["a.png"].decoded and not rows["b.jpg"].decoded
    assert rows["a.png"].top_hex == "#c81e1e" and (rows["a.png"].width, rows["a.png"].aspect, rows["a.png"].taken_at_source) == (120, 1.5, "mtime")
    assert rows["b.jpg"].taken_at == at(2024, 5, 6, 7, 8, 9) and rows["b.jpg"].brightness == 0.5 and len(rows["b.jpg"].phash) == 16
    assert [r["name"] for r in skipped(read_images(spark, str(tmp_path))).collect()] == ["b.jpg"]
    assert rows["b.jpg"].camera.asDict() == {"make": "Canon", "model": None, "f_number": 1.8, "iso": 400, "focal_length": None, "exposure": None} and rows["a.png"].camera is None
    (tmp_path / "c.WebP").write_bytes(b"no picture")
    assert {r["name"] for r in skipped(read_images(spark, str(tmp_path))).collect()} == {"b.jpg", "c.WebP"}


def java_image(spark, rgb, ending, path):
    """An image file written by the JVM."""
    jvm = spark._jvm
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    assert jvm.javax.imageio.ImageIO.write(image, ending, jvm.java.io.File(str(path)))


def filtered(rgb, kinds):
    """A PNG whose rows are filtered by the given kinds in turn."""
    h, w, n = rgb.shape
    flat, lines = rgb.reshape(h, w * n).astype(int), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left, corner = np.concatenate([np.zeros(n, int), flat[y][:-n]]), np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        kind = kinds[y % len(kinds)]
        lines.append(bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
    whole = png_file.encode(rgb)
    return whole[:8] + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", whole[16:29]), (b"IDAT", zlib.compress(b"".join(lines))), (b"IEND", b"")))


def test_png_round_trip_with_all_filters(tmp_path):
    r = np.random.default_rng(5)
    for shape in ((1, 1, 3), (5, 9, 3), (40, 17, 3)):
        rgb = r.integers(0, 256, shape).astype(np.uint8)
        for kinds in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [4, 3, 1]):
            assert (png_file.decode(filtered(rgb, kinds)) == rgb).all()
        whole = filtered(rgb, [4])
        assert all(png_file.decode(whole[:k]) is None for k in range(len(whole) - 12)) and png_file.decode(whole[:-40] + b"x" * 40) is None


def test_one_look_into_each_file_gives_the_same_rows(spark, tmp_path):
    r, folder = np.random.default_rng(6), tmp_path / "in"
    (folder / "sub" / ".hidden").mkdir(parents=True)
    rgb = r.integers(0, 256, (90, 70, 3)).astype(np.uint8)
    (folder / "a.png").write_bytes(png_file.encode(rgb))
    (folder / "b.PNG").write_bytes(filtered(rgb, [4, 2, 1]))
    java_image(spark, rgb, "png", folder / "sub" / "c.png")
    java_image(spark, rgb, "jpg", folder / "sub" / "d.jpg")
    java_image(spark, rgb, "gif", folder / "e.gif")
    (folder / "f.png").write_bytes(png_file.encode(rgb)[:-300])  # broken
    (folder / "g.png").write_bytes((folder / "sub" / "d.jpg").read_bytes())  # a photo by another name
    (folder / "h.jpg").write_bytes(jpeg("<"))
    (folder / "i.webp").write_bytes(b"no picture")
    (folder / "j.png").write_bytes(b"")
    (folder / "l.jpg").write_bytes(jpeg(">") + b"\0" * 400_000)
    (folder / "_k.png").write_bytes(png_file.encode(rgb))
    (folder / "sub" / ".hidden" / "x.png").write_bytes(png_file.encode(rgb))
    (folder / "notes.txt").write_text("no image")
    gray = np.concatenate([np.zeros((30, 1)), r.integers(0, 256, (30, 20))], axis=1).astype(np.uint8)
    (folder / "m.png").write_bytes(png_file.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", struct.pack(">IIBBBBB", 20, 30, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(gray.tobytes())), (b"IEND", b""))))
    slow = {x["name"]: x for x in read_images(spark, str(folder)).collect()}
    fast = {x["name"]: x for x in scan_images(spark, str(folder)).collect()}
    assert set(slow) | {"j.png"} == set(fast) == set("a.png b.PNG c.png d.jpg e.gif f.png g.png h.jpg i.webp j.png l.jpg m.png".split())  # Spark lists no empty files
    assert all(fast[n][k] == slow[n][k] for n in slow for k in slow[n].asDict())
    assert {n for n in fast if fast[n].decoded} == {"a.png", "b.PNG", "c.png", "d.jpg", "e.gif", "g.png", "m.png"}
    # bytes: whole files where they are decoded at once, else heads only
    sizes = {n: fast[n].size_bytes for n in fast}
    assert {n: fast[n].bytes_read for n in fast} == {n: min(s, 262_144) if n in ("d.jpg", "e.gif", "g.png", "h.jpg", "i.webp", "j.png", "l.jpg") else s for n, s in sizes.items()} and sizes["l.jpg"] > 400_000
    heads = scan_images(spark, str(folder), pixels=False)
    told = {x["name"]: x for x in heads.collect()}
    assert all(told[n][k] == fast[n][k] for n in told for k in set(heads.columns) - {"bytes_read"}) and set(told) == set(fast)
    assert all(told[n].bytes_read == min(sizes[n], 262_144) for n in told) and "phash" not in heads.columns and told["h.jpg"].taken_at == at(2024, 5, 6, 7, 8, 9)


def test_files_are_opened_once_each(tmp_path, monkeypatch):
    """Counts what the file system is asked for."""
    for k in range(5):
        (tmp_path / f"{k}.png").write_bytes(png_file.encode(np.random.default_rng(k).integers(0, 256, (400, 400, 3)).astype(np.uint8)))
    reads = []

    class Counted:
        def __init__(self, file, path):
            self.file, self.path = file, path

        def __enter__(self):
            self.file.__enter__()
            return self

        def __exit__(self, *x):
            return self.file.__exit__(*x)

        def read_at(self, n, at):
            data = self.file.read_at(n, at)
            reads.append((self.path, at, len(data)))
            return data

    class System:
        def open_input_file(self, path):
            reads.append((path, "open", 0))
            return Counted(files.fs.LocalFileSystem().open_input_file(path), path)

    whole = files.listed(str(tmp_path))
    for path, size, _ in whole:
        reads.clear()
        assert files.opened(System(), path, size, False)["bytes_read"] == 262_144 and reads == [(path, "open", 0), (path, 0, 262_144)]
        reads.clear()
        out = files.opened(System(), path, size, True)
        assert out["bytes_read"] == size and reads == [(path, "open", 0), (path, 0, 262_144), (path, 262_144, size - 262_144)] and (out["width"], len(out["rgba"])) == (400, 64 * 64 * 4)


def test_partitions_carry_equal_work():
    r = random.Random(7)
    sizes = [(f"f{k:04d}", int(10 ** r.uniform(3, 8)), 0) for k in range(3000)]
    parts = files.dealt(sizes, True, 16)
    work = [sum(files.OPEN_BYTES + size for _, size, _ in p.files) for p in parts]
    assert sorted(x for p in parts for x in p.files) == sizes and max(work) <= 1.1 * max(sum(work) / len(work), 10**8) and len(parts) > 16
    heads = files.dealt(sizes, False, 16)
    assert len(heads) < len(parts) and files.dealt([], True, 4) == []


def test_files_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.bin", bytes([k] * k)) for k in range(30)] + [(None, b"x"), ("y", None)], "name string, content binary").repartition(4)
    for _ in range(2):  # again over the same folder
        files.registered(spark).createDataFrame(rows.collect(), rows.schema).write.format("photo_files").option("path", str(tmp_path / "out")).mode("append").save()
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{k}.bin": bytes([k] * k) for k in range(30)}
    (tmp_path / "out" / "old.bin").write_bytes(b"old")
    rows.limit(1).write.format("photo_files").option("path", str(tmp_path / "out")).mode("overwrite").save()
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_wall_clocks_do_not_depend_on_the_zone_of_the_session(spark):
    rows = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.123456' as ts union all select timestamp_ntz'1969-12-31 23:59:59.999'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for own in ("UTC", "Europe/Berlin", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", own)
            assert [r.ms for r in rows.select(wall_millis(F.col("ts")).alias("ms")).collect()] == [at(2024, 3, 31, 2, 30) + 123, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_streamed_sessions_equal_those_of_a_table(spark, tmp_path):
    rows = [photo(f"s{i}", taken_at=at(2026, 7, 1 + i // 4, i % 4 * 3)) for i in range(12)]
    frame(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = stream_sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = {(r.start, r.end, r.n) for r in stream_sessions(frame(spark, rows)).collect()}
    assert {tuple(r) for r in spark.sql("select start, end, n from streamed").collect()} <= table
    batch = tl.sessions(frame(spark, rows)).groupBy("session_start").count().collect()
    assert {(s, n) for s, _, n in table} == {tuple(r) for r in batch}


def test_streamed_trips_equal_those_of_a_table(spark, tmp_path):
    r, rows, day = random.Random(14), [], 86_400_000
    for library in range(4):
        t = at(2024, 1, 1)
        for _ in range(220):
            t += int(r.choice([0, 60_000, 4 * 3_600_000, 4 * 3_600_000 + 1, 6 * 3_600_000, 18 * 3_600_000, 18 * 3_600_000 + 1, 0.9 * day, 2 * day]) * r.choice([1, 1, r.random()]))
            rows.append((library, t, r.random() < 0.8, r.choice([None, 10.0, 20_000.0, 30_000.0, 30_001.0, 90_000.0]) if library else None))
    schema = "library_id long, taken_at long, counted boolean, meters double"
    options = TimelineOptions(trip_min_photos=6)
    whole = {tuple(x) for x in stream_trips(spark.createDataFrame(rows, schema), options).collect()}
    assert sum(x[-1] for x in whole) > 3 and len(whole) > 60
    arriving = sorted(rows, key=lambda x: x[1] + r.uniform(0, 3 * day))  # up to three days out of order
    step = len(arriving) // 9 + 1
    parts = [arriving[k : k + step] for k in range(0, len(arriving), step)] + [[(99, max(x[1] for x in rows) + 30 * day, True, None)]]  # a last photo elsewhere moves the watermark on
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = stream_trips(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), options, "4 days")
    query = stream.writeStream.format("memory").queryName("trips").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = [tuple(None if v != v else v for v in x) for x in spark.sql("select * from trips").collect()]
    assert len(got) == len(set(got)) and set(got) == whole


def test_sessions_merge_in_any_order():
    r = random.Random(15)
    photos = [[t, t, 1, 1, float(t % 7)] for t in (r.randrange(10**6) for _ in range(200))]
    whole = joined(photos, 5000)
    for _ in range(20):
        r.shuffle(photos)
        held = []
        for k in range(0, 200, 17):
            held = joined(held + photos[k : k + 17], 5000)
        assert held == whole and sum(s[2] for s in held) == 200 and all(b[0] - a[1] > 5000 for a, b in zip(held, held[1:]))


def test_the_entry_can_be_imported_without_a_session():
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 30)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip().endswith("True"), said.stderr[-500:]


def test_only_what_is_asked_for_is_measured(spark, monkeypatch):
    stack = np.random.default_rng(3).integers(0, 256, (5, 64, 64, 3)).astype(np.uint8)
    whole = pixels.features(stack, list(range(5)))
    monkeypatch.setattr(pixels, "main_colors", lambda *_: 1 / 0)
    assert list(pixels.features(stack, list(range(5)), ("phash",))["phash"]) == list(whole["phash"])
    names = ("brightness", "colorfulness", "edge_density")
    own = pixels.features(stack, list(range(5)), names)
    assert all((own[k] == whole[k]).all() for k in names)


def test_pixels_of_one_color_are_one_point():
    stack = np.repeat(np.random.default_rng(4).integers(0, 256, (3, 8, 8, 3)), 8, axis=1).repeat(8, axis=2).astype(np.uint8)
    other = np.random.default_rng(5).integers(0, 256, (1, 64, 64, 3)).astype(np.uint8)
    together = pixels.main_colors(np.concatenate([stack, other]), [1, 2, 3, 4])
    alone = [pixels.main_colors(x[None], [k]) for k, x in enumerate([*stack, *other], 1)]
    assert together == ([x[0][0] for x in alone], [x[1][0] for x in alone])


def test_images_are_listed_by_tasks_and_their_pixels_are_not_kept(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(8)
    rgb = [r.integers(0, 256, (64, 64, 3)).astype(np.uint8) for _ in range(60)]
    rows = spark.createDataFrame([(f"{k}[{k % 3}].png", png_file.encode(x)) for k, x in enumerate(rgb)], "name string, content binary").repartition(3)
    for _ in range(2):
        files.registered(spark).createDataFrame(rows.collect(), rows.schema).write.format("photo_files").option("path", str(tmp_path)).option("folders", "7").mode("append").save()
    folders = sorted(tmp_path.iterdir())
    assert len(folders) == 7 and all(0 < len(list(x.iterdir())) < 60 for x in folders)
    told = list(files.list_files(spark, str(tmp_path)).collect())
    assert sorted(tuple(x) for x in told) == files.listed(str(tmp_path)) and len(told) == 60
    kept, own = [], images.shared_table
    monkeypatch.setattr(images, "shared_table", lambda df: kept.append(df.columns) or own(df))
    monkeypatch.setattr(images, "_shown", lambda *_: 1 / 0)  # Spark lists what it decodes, which is nothing here
    got = {x.name: x for x in scan_images(spark, str(tmp_path), colors=False).collect()}
    assert len(got) == 60 and all(x.decoded and x.bytes_read == x.size_bytes for x in got.values()) and kept and not any("rgba" in x for x in kept)
    monkeypatch.undo()
    # files that Spark decodes, a few at a time, by names that hold signs of patterns
    for k in range(5):
        java_image(spark, rgb[k], "jpg", folders[k] / f"{k}{{a,b}}[x]*.jpg")
    monkeypatch.setattr(images, "MOST_PATHS", 2)
    slow = {x["name"]: x for x in read_images(spark, str(tmp_path)).collect()}
    fast = {x["name"]: x for x in scan_images(spark, str(tmp_path)).collect()}
    assert set(slow) == set(fast) and len(fast) == 65 and all(fast[n].decoded and fast[n][k] == slow[n][k] for n in slow for k in slow[n].asDict())
