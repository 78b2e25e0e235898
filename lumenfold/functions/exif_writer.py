"""The head of a JPEG file with EXIF tags, as a column: what `lumenfold.functions.exif` reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import exif

TEXT, SHORT, LONG, RATIO = 2, 3, 4, 5
#: A tag that nothing reads, for values that are null.
UNKNOWN = 0xEA1C


@dataclass(frozen=True)
class Entry:
    """A tag with its type, its number of values, and their bytes as hexadecimal digits; unread if `there` is false."""

    tag: int
    kind: int
    count: int
    digits: Column
    there: Column

    @property
    def size(self) -> int:
        return exif.SIZES[self.kind] * self.count


def _number(value: Column, size: int, little: Column) -> Column:
    """The digits of a whole number in `size` bytes, in either byte order."""
    big = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.when(little, F.concat(*(F.substring(big, 2 * k + 1, 2) for k in reversed(range(size))))).otherwise(big)


def text(tag: int, value: Column, size: int) -> Entry:
    """ASCII in `size` bytes, ended by a zero."""
    return Entry(tag, TEXT, size, F.rpad(F.hex(F.substring(F.coalesce(value, F.lit("")), 1, size - 1).cast("binary")), 2 * size, "0"), value.isNotNull())


def whole(tag: int, value: Column, little: Column, kind: int = SHORT) -> Entry:
    return Entry(tag, kind, 1, _number(F.coalesce(value, F.lit(0)), exif.SIZES[kind], little), value.isNotNull())


def ratios(tag: int, little: Column, *parts: tuple[Column, Column]) -> Entry:
    """Fractions, each of a numerator and a denominator; unread if the first numerator is null."""
    digits = F.concat(*(_number(F.coalesce(x, F.lit(0)), 4, little) for part in parts for x in part))
    return Entry(tag, RATIO, len(parts), digits, parts[0][0].isNotNull())


def _directory(entries: list[Entry], start: int, little: Column) -> tuple[Column, int]:
    """The digits of a directory that begins `start` bytes into the block, and its size; values of over four bytes come after it."""
    at = start + 2 + 12 * len(entries) + 4
    rows, after = [_number(F.lit(len(entries)), 2, little)], []
    for e in entries:
        rows += [_number(F.when(e.there, e.tag).otherwise(UNKNOWN), 2, little), _number(F.lit(e.kind), 2, little), _number(F.lit(e.count), 4, little)]
        if e.size <= 4:
            rows.append(F.rpad(e.digits, 8, "0"))
        else:
            rows.append(_number(F.lit(at), 4, little))
            after.append(e.digits)
            at += e.size
    return F.concat(*rows, F.lit("00000000"), *after), at - start


def jpeg_head(top: list[Entry], own: list[Entry], gps: list[Entry], little: Column, before: Column | None = None) -> Column:
    """A JPEG file without an image: tags of the file, of the photo and of its place, after the digits `before`."""

    def linked(own_at: int, gps_at: int) -> tuple[Column, int]:
        return _directory([*top, whole(exif.EXIF_DIR, F.lit(own_at), little, LONG), whole(exif.GPS_DIR, F.lit(gps_at), little, LONG)], 8, little)

    own_at = 8 + linked(0, 0)[1]
    photo, size = _directory(own, own_at, little)
    place, gps_size = _directory(gps, own_at + size, little)
    block = F.concat(F.when(little, "4949").otherwise("4D4D"), _number(F.lit(42), 2, little), _number(F.lit(8), 4, little), linked(own_at, own_at + size)[0], photo, place)
    length = 2 + 6 + own_at + size + gps_size
    return F.unhex(F.concat(F.lit("FFD8"), F.lit("") if before is None else before, F.lit("FFE1"), F.lit(f"{length:04X}"), F.lit("457869660000"), block, F.lit("FFD9")))
