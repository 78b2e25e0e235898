"""A made-up library of some 180 photos, in which every kind of album occurs: for trying things out, and for the tests."""

from __future__ import annotations

import random
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "library_id long, id string, name string, taken_at long, lat double, lon double, phash string, brightness double, saturation double, edge_density double, warmth double, "
    "colorfulness double, blue_top_ratio double, green_ratio double, luma_variance double, aspect double, camera_make string, camera_model string, f_number double, iso long, top_hex string"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def at(y, mo, d, h=12, mi=0, s=0):
    """Epoch ms of a wall clock."""
    return int(datetime(y, mo, d, tzinfo=timezone.utc).timestamp() * 1000) + ((h * 60 + mi) * 60 + s) * 1000


def photo(id, **own):
    """A row with defaults."""
    row = {
        "library_id": 1, "name": f"{id}.jpg", "taken_at": None, "lat": None, "lon": None, "phash": f"{random.Random(id).getrandbits(64):016x}", "brightness": 0.5, "saturation": 0.3, "edge_density": 0.2, "warmth": 0.0,
        "colorfulness": 30.0, "blue_top_ratio": 0.0, "green_ratio": 0.0, "luma_variance": 0.04, "aspect": 4 / 3, "camera_make": "Apple", "camera_model": "iPhone", "f_number": 1.8, "iso": 100, "top_hex": "#808080",
    } | own
    return tuple(float(v) if n in ("lat", "lon") and v is not None else v for n, v in ((n, (row | {"id": id})[n]) for n in NAMES))


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def demo_photos(spark: SparkSession) -> DataFrame:
    """The demo library as a table."""
    return frame(spark, demo())


def demo():
    """A library of somebody in 札幌: walks near home, a trip to 函館, a festival, a lake with a second camera, series, scenes and leftovers."""
    rows = []

    def add(id, **own):
        rows.append(photo(id, **own))

    def spot(lat, lon, k):
        """Places some 30 m apart."""
        return {"lat": lat + 0.0003 * (k % 4), "lon": lon + 0.0003 * (k // 4 % 3)}

    for k in range(48):  # a Wednesday each week
        add(f"walk{k:02d}", taken_at=at(2023, 1, 4) + k * 7 * 86_400_000 + k * 1_234_567, **spot(43.0650, 141.3470, k))
    for k in range(26):
        add(f"hakodate{k:02d}", taken_at=at(2023, 2, 18 + k // 13, 8 + k % 13, 7 * k % 60), top_hex="#203050", **spot(41.7690, 140.7290, k))
    for k in range(9):
        add(f"snow{k}", taken_at=at(2023, 2, 11, 10, 11 * k % 60, k), brightness=0.6, edge_density=0.3, top_hex="#dde4ee", lat=43.2 + 0.004 * k, lon=141.0)
    for k in range(36):
        add(f"bird{k:02d}", taken_at=at(2023, 5, 3 + 2 * (k // 3), 6, 20 * (k % 3)), camera_make="PENTAX", camera_model="PENTAX K-3", f_number=5.6, top_hex="#3a5a4a", lat=42.70 + 0.01 * (k % 5), lon=141.72)
    owl = 0x5AA5_0F33_9C1E_7B42
    for k in range(5):
        add(f"owl{k}", taken_at=at(2023, 6, 4, 21) + 250 * k, phash=f"{owl ^ (3 << 7 * k):016x}", edge_density=0.2 + 0.05 * k, f_number=5.6)
    for k in range(4):
        add(f"copy{k}", phash="00ff13579bdf2468", camera_make=None, camera_model=None, taken_at=at(2023, 7, 1 + 3 * k, 9) if k else None)
    for k in range(7):
        add(f"fireworks{k}", taken_at=at(2023, 8, 5, 20, 4 * k), brightness=0.2, iso=3200, top_hex="#101830", colorfulness=50.0, lat=43.03, lon=141.40)
    for k in range(8):
        add(f"garden{k}", taken_at=at(2023, 7, 2 + 4 * (k // 2), 13, k), green_ratio=0.5 + 0.02 * k, saturation=0.5, top_hex="#2f8f3f")
    for k in range(6):
        add(f"grey{k}", taken_at=at(2023, 9, 1 + 5 * k // 2, 17), saturation=0.03, edge_density=0.3, top_hex="#777777")
    for k in range(7):
        add(f"dusk{k}", taken_at=at(2023, 10, 1 + 3 * k, 16, 40), top_hex="#e07830", warmth=0.3, colorfulness=45.0, aspect=1.5, brightness=0.45)
    for k in range(6):
        add(f"soup{k}", taken_at=at(2023, 11, 2 * k + 1, 19, 5), top_hex="#40a0a0", warmth=0.1, saturation=0.6, colorfulness=70.0, aspect=1.0)
    for k in range(7):
        add(f"sky{k}", taken_at=at(2023, 4, 3 * k + 1, 12, 30), blue_top_ratio=0.45 + 0.05 * k, brightness=0.8, edge_density=0.05, top_hex="#66aaee")
    for k in range(9):
        add(f"page{k}", name=f"スクリーンショット {k}.png", taken_at=at(2023, 3, 2 * k + 1, 22), camera_make=None, camera_model=None, f_number=None, iso=None, brightness=0.85, saturation=0.1, edge_density=0.4)
    for k in range(3):
        add(f"undated{k}", top_hex=None, camera_make=None, camera_model=None)
    for k in range(2):
        add(f"old{k}", taken_at=at(2021, 11, 5 + 9 * k), aspect=0.75)
    return rows
