"""EXIF tags of JPEG bytes, for use on Arrow batches; anything unreadable gives empty fields, never an error."""

from __future__ import annotations

import math
import re
import struct
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions.types import struct_of

FIELDS = "taken_at long, lat double, lon double, make string, model string, orientation long, f_number double, iso long, focal_length double, exposure double, pixel_width double, pixel_height double"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]

# Sizes and struct codes of the numeric TIFF types, and tag numbers.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WHOLE = {1: "B", 3: "H", 4: "I", 7: "B", 8: "h", 9: "i"}
MAKE, MODEL, ORIENTATION, EXIF_DIR, GPS_DIR = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825
TAKEN, DIGITIZED, F_NUMBER, ISO, FOCAL, EXPOSURE, WIDTH, HEIGHT = 0x9003, 0x9004, 0x829D, 0x8827, 0x920A, 0x829A, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4


def exif_time(text: str | None) -> int | None:
    """Epoch ms of `YYYY:MM:DD HH:MM:SS` as a wall clock; parts beyond their range carry over; two-digit years are of the 1900s."""
    m = re.match(r"([0-9]{4}):([0-9]{2}):([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})", (text or "").strip())
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    if not (y and mo and d):
        return None
    y = (1900 + y if y < 100 else y) + (mo - 1) // 12
    try:
        at = datetime(y, (mo - 1) % 12 + 1, 1) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)
    except (ValueError, OverflowError):
        return None
    return (at - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def degrees(d: float, m: float, s: float, ref: str | None) -> float:
    """Decimal degrees; south and west are negative."""
    return (d + m / 60 + s / 3600) * (-1 if (ref or "").strip().upper() in ("S", "W") else 1)


class Tiff:
    """The tags of a TIFF block."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start = data, start
        self.order = {b"II": "<", b"MM": ">"}.get(data[start : start + 2])
        self.good = self.order is not None and self.number("H", start + 2) == 42

    def number(self, code: str, at: int) -> int | None:
        size = struct.calcsize(code)
        return struct.unpack_from(self.order + code, self.data, at)[0] if 0 <= at <= len(self.data) - size else None

    def directory(self, offset: int | None) -> dict[int, tuple[int, int, int]]:
        """(type, count, place) of each tag."""
        count = None if offset is None else self.number("H", self.start + offset)
        tags = {}
        for k in range(count if count is not None and count <= 4096 else 0):
            at = self.start + offset + 2 + 12 * k
            if at + 12 > len(self.data):
                break
            tag, kind, n, value = struct.unpack_from(self.order + "HHII", self.data, at)
            place = at + 8 if SIZES.get(kind, 1) * n <= 4 else self.start + value
            if place <= len(self.data):
                tags[tag] = kind, n, place
        return tags

    def text(self, entry) -> str | None:
        if entry is None:
            return None
        _, n, place = entry
        return self.data[place : min(place + n, len(self.data))].split(b"\0")[0].decode("latin-1").strip() or None

    def whole(self, entry) -> int | None:
        return self.number(WHOLE[entry[0]], entry[2]) if entry and entry[0] in WHOLE else None

    def ratio(self, entry, k: int = 0) -> float | None:
        if entry is None:
            return None
        code = "i" if entry[0] == 10 else "I"
        over, under = (self.number(code, entry[2] + 8 * k + x) for x in (0, 4))
        return None if over is None or under is None else over / under if under else 0.0

    def any_number(self, entry) -> float | None:
        found = self.ratio(entry) if entry and entry[0] in (5, 10) else self.whole(entry)
        return None if found is None else float(found)


def _hundredth(x: float | None) -> float | None:
    return None if x is None else math.floor(x * 100 + 0.5) / 100


def parse_exif(data: bytes | None) -> dict:
    """The fields of NAMES; None where missing."""
    out = dict.fromkeys(NAMES)
    data = bytes(data or b"")
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            at += 1
        elif marker in (0xD9, 0xDA):
            break
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        else:
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            if length < 2:
                break
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return out | _tags(Tiff(data, at + 10))
            at += 2 + length
    return out


def _tags(tiff: Tiff) -> dict:
    if not tiff.good:
        return {}
    top = tiff.directory(tiff.number("I", tiff.start + 4))
    own, gps = (tiff.directory(tiff.whole(top.get(tag))) for tag in (EXIF_DIR, GPS_DIR))
    out = {
        "make": tiff.text(top.get(MAKE)),
        "model": tiff.text(top.get(MODEL)),
        "orientation": tiff.whole(top.get(ORIENTATION)),
        "taken_at": exif_time(tiff.text(own.get(TAKEN, own.get(DIGITIZED)))),
        "f_number": _hundredth(tiff.ratio(own.get(F_NUMBER))),
        "iso": tiff.whole(own.get(ISO)),
        "focal_length": _hundredth(tiff.ratio(own.get(FOCAL))),
        "exposure": tiff.ratio(own.get(EXPOSURE)),
        "pixel_width": tiff.any_number(own.get(WIDTH)),
        "pixel_height": tiff.any_number(own.get(HEIGHT)),
    }
    parts = [tiff.ratio(gps.get(tag), k) for tag in (LAT, LON) for k in range(3)]
    if None not in parts:
        out |= {"lat": degrees(*parts[:3], tiff.text(gps.get(LAT_REF))), "lon": degrees(*parts[3:], tiff.text(gps.get(LON_REF)))}
    return out


@F.pandas_udf(struct_of(FIELDS))
def exif_fields(head: pd.Series) -> pd.DataFrame:
    """The struct of EXIF fields of the first bytes of a file."""
    return pd.DataFrame([parse_exif(x) for x in head], columns=NAMES).astype({"taken_at": "Int64", "orientation": "Int64", "iso": "Int64"})
