"""Numbers, bits, distances and colours as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METERS, METERS_PER_DEGREE = 6_371_000.0, 111_320.0
DAY_MS = 86_400_000

# The order in which kinds of albums are shown and survive.
KINDS = ("trip", "place", "day", "scene", "burst", "screenshot", "device", "monthly")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, wherever the optimizer moves or copies the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves upward (Spark's round goes away from zero)."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """NaN and null become `low`."""
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def popcount32(x: Column) -> Column:
    return F.bit_count(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def hash_bits(phash: Column) -> Column:
    """The 64 bits of a 16-digit hexadecimal hash as long; null for any other length."""
    return F.when(F.length(phash) == 16, F.conv(phash, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; 64 if one isn't of 16 digits."""
    return F.coalesce(F.bit_count(hash_bits(a).bitwiseXOR(hash_bits(b))), F.lit(64))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_METERS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def valid_gps(lat: Column, lon: Column) -> Column:
    """Finite, in range and not at (0, 0); false for nulls."""
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)), F.lit(False))


def grid_cell(lat: Column, lon: Column, meters: float) -> Column:
    """`row:column` of a grid of about `meters`; columns shrink with the latitude of each place."""
    scale = METERS_PER_DEGREE * F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(lat))))
    return F.concat_ws(":", round_half_up(lat / (meters / METERS_PER_DEGREE)).cast("string"), round_half_up(lon / (meters / scale)).cast("string"))


def day_index(ms: Column) -> Column:
    return F.floor(ms / DAY_MS)


def hue_bin(hue: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(F.pmod(hue, F.lit(360.0)) / 360 * bins)).cast("int")


def cover_score(edge_density: Column, brightness: Column, colorfulness: Column) -> Column:
    """Sharpness, middling exposure and colour."""
    exposure = 1 - F.least(F.lit(1.0), F.abs(brightness - 0.5) * 2)
    return 0.5 * clamp01(edge_density) + 0.3 * exposure + 0.2 * clamp01(colorfulness / 100)


def jaccard(common: Column, size_a: Column, size_b: Column) -> Column:
    """From the sizes of two sets and of their intersection; two empty sets are equal."""
    union = size_a + size_b - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def array_jaccard(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def album_priority(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def hex_channel(color: Column, at: int) -> Column:
    """Red, green or blue (0, 1, 2) of `#rrggbb`."""
    return F.conv(F.substring(color, 2 + 2 * at, 2), 16, 10).cast("int")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 360), saturation and value (0 to 1) of channels from 0 to 255."""
    r, g, b = r / 255, g / 255, b / 255
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    sector = F.when(high == r, F.try_divide(g - b, d) % 6).when(high == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    hue = F.when(d == 0, 0.0).otherwise(sector * 60)
    return F.when(hue < 0, hue + 360).otherwise(hue), F.when(high == 0, 0.0).otherwise(F.try_divide(d, high)), high


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB channels from 0 to 255."""

    def linear(c: Column) -> Column:
        return F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))

    def bent(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    r, g, b = linear(r), linear(g), linear(b)
    x = bent((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = bent(0.2126729 * r + 0.7151522 * g + 0.072175 * b)
    z = bent((0.0193339 * r + 0.119192 * g + 0.9503041 * b) / 1.08883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b)))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    def two(c: Column) -> Column:
        return F.lpad(F.lower(F.hex(round_half_up(clamp(c.cast("double"), 0.0, 255.0)).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), two(r), two(g), two(b))
