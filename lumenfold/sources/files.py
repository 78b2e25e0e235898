"""Image files, each opened once: `open_files`, and the data source `photo_files`.

`open_files` takes folders of any size: tasks list them, level by level, and files are dealt to tasks as rows, so that nobody holds a
list of them. A task opens each of its files once, reads its first 256 KiB for the EXIF tags, and the rest only if pixels are asked for
and the file is of a kind that is decoded here (`lumenfold.functions.png`). Reading `photo_files` gives the same rows; there the driver
lists the files and deals them to partitions of about equal work, as a data source has to. Writing it: rows (name, content) become
files of a folder, or of folders below it.

Spark's own decoder, for all other kinds, reads by path, so these are the only files that pixels cost a second look at
(`lumenfold.sources.images.scan_images`).
"""

from __future__ import annotations

import heapq
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.checkpoint import shared_table
from lumenfold.functions import exif, pixels, png

SIDE, HEAD_BYTES = 64, 262_144
#: The work of opening a file, in bytes, and that of a partition.
OPEN_BYTES, PART_BYTES = 1 << 16, 128 << 20
ENDINGS = ("jpg", "jpeg", "jfif", "png", "gif", "bmp", "heic", "heif", "webp", "tif", "tiff", "avif", "svg", "ico")


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or url, the path in it, and what goes before the paths of its files."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file:"):
        system, inside = fs.FileSystem.from_uri(path)
        return system, inside, path.split("://", 1)[0] + "://"
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path)), "file:"


@dataclass
class Files(InputPartition):
    """(path, size, time of change in ms) of each."""

    files: list[tuple[str, int, int]]


def listed(path: str, endings: tuple[str, ...] = ENDINGS) -> list[tuple[str, int, int]]:
    """The files below a folder with these endings, in any case; as Spark does, without those in or named like hidden ones."""
    system, inside, _ = file_system(path)
    if system.get_file_info(inside).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found, folders = [], [inside]
    for folder in folders:
        for path, size, changed in looked_into(system, folder, endings):
            if size is None:
                folders.append(path)
            else:
                found.append((path, size, changed))
    return sorted(found)


def looked_into(system: fs.FileSystem, folder: str, endings: tuple[str, ...] = ENDINGS) -> Iterator[tuple[str, int | None, int | None]]:
    """(path, size, time of change in ms) of the files with these endings in a folder, and (path, None, None) of the folders in it; without hidden ones.

    One at a time where files are local; other file systems give a folder's entries at once.
    """

    def shown(name: str) -> bool:
        return not name.startswith(("_", "."))

    def ends(name: str) -> bool:
        return "." in name and name.lower().rpartition(".")[2] in endings

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory and shown(info.base_name):
                yield info.path, None, None
            elif info.type == fs.FileType.File and shown(info.base_name) and ends(info.base_name):
                yield info.path, info.size, (info.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if not shown(entry.name):
                continue
            if entry.is_dir():
                yield entry.path, None, None
            elif ends(entry.name) and entry.is_file():
                told = entry.stat()
                yield entry.path, told.st_size, told.st_mtime_ns // 1_000_000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, changed) of the files below a folder, as `listed`: tasks look into the folders of one level after the other."""
    system, inside, _ = file_system(path)
    if system.get_file_info(inside).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = file_system(path)[0]
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for rows in batched(looked_into(system, folder), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    found, due = None, spark.range(1).select(F.lit(inside).alias("path")).coalesce(1)
    while True:
        level = shared_table(due.mapInArrow(look, "path string, size long, changed long"))
        files, folders = level.where("size is not null"), level.where("size is null").select("path")
        found = files if found is None else found.unionByName(files)
        if folders.isEmpty():
            return found
        due = folders.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def open_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The rows of `photo_files` below a folder of any size; files meet tasks by a hash of their paths, so that these have about equal work."""
    files = list_files(spark, path)
    size = F.col("size") if whole else F.least("size", F.lit(HEAD_BYTES))
    work = files.agg(F.sum(size + OPEN_BYTES)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-work // PART_BYTES))
    schema = row_schema()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from opened_rows(path, zip(*(batch.column(k).to_pylist() for k in ("path", "size", "changed"))), whole, to_arrow_schema(schema))

    return files.repartition(parts, "path").mapInArrow(read, schema)


def dealt(files: list[tuple[str, int, int]], whole: bool, parts: int) -> list[Files]:
    """The files in `parts` parts or more, of about equal work: the largest first, each to the part with the least so far."""
    work = [OPEN_BYTES + (size if whole else min(size, HEAD_BYTES)) for _, size, _ in files]
    count = min(len(files), max(parts, -(-sum(work) // PART_BYTES)))
    heap = [(0, k) for k in range(count)]
    out: list[list] = [[] for _ in range(count)]
    for k in sorted(range(len(files)), key=lambda k: (-work[k], k)):
        load, part = heapq.heappop(heap)
        out[part].append(files[k])
        heapq.heappush(heap, (load + work[k], part))
    return [Files(sorted(x)) for x in out]


def squashed(grid: np.ndarray) -> bytes:
    """64 x 64 RGBA by means of boxes; grey is spread over the colours."""
    rgb = grid if grid.shape[2] == 3 else np.repeat(grid, 3, axis=2)
    if rgb.shape[:2] != (SIDE, SIDE) or rgb.dtype != np.uint8:
        rgb = np.floor(pixels.box_resample(rgb, SIDE, SIDE) + 0.5).astype(np.uint8)
    out = np.full((SIDE, SIDE, 4), 255, np.uint8)
    out[..., :3] = rgb
    return out.tobytes()


def opened(system: fs.FileSystem, path: str, size: int, whole: bool) -> dict:
    """What one look into a file gives. `here` tells that the file is of a kind that is decoded here, well or not."""
    with system.open_input_file(path) as file:
        head = file.read_at(min(size, HEAD_BYTES), 0)
        out = {"exif": exif.parse_exif(head), "here": png.readable(head), "bytes_read": len(head), "width": None, "height": None, "rgba": None}
        if whole and out["here"]:
            rest = file.read_at(size - len(head), len(head)) if size > len(head) else b""
            out["bytes_read"] += len(rest)
            grid = png.decode(head + rest)
            if grid is not None:
                out |= {"height": grid.shape[0], "width": grid.shape[1], "rgba": squashed(grid)}
    return out


def row_schema() -> T.StructType:
    own = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in exif.FIELDS.split(", "))
    return T.StructType.fromDDL(f"path string, mtime long, size_bytes long, bytes_read long, here boolean, exif struct<{own}>, width int, height int, rgba binary")


def opened_rows(path: str, files: Iterable[tuple[str, int, int]], whole: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each of these files below `path`."""
    system, _, before = file_system(path)
    for some in batched(files, 256):
        yield pa.RecordBatch.from_pylist([{"path": before + at, "mtime": changed, "size_bytes": size} | opened(system, at, size, whole) for at, size, changed in some], schema=schema)


class PhotoFiles(DataSource):
    """Options of reading: `path`; `pixels` (true or false); `parts`, the least number of partitions. Of writing: `path`; `folders`."""

    @classmethod
    def name(cls) -> str:
        return "photo_files"

    def schema(self) -> T.StructType:
        return row_schema()

    def reader(self, schema) -> PhotoReader:
        return PhotoReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> PhotoWriter:
        return PhotoWriter(self.options, overwrite)


class PhotoReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.whole, self.parts = options["path"], options.get("pixels", "true").lower() == "true", int(options.get("parts", "8"))
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path), self.whole, self.parts) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from opened_rows(self.path, partition.files, self.whole, self.arrow)


class PhotoWriter(DataSourceWriter):
    """Each row's content goes to a hidden file first, which then takes its name; so a task that is run again leaves the same files.

    With an option `folders` of 1 or more, the files lie in as many folders, by a hash of their names, so that no folder gets too large to be listed.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.folders = options["path"], int(options.get("folders", "0"))
        system, inside, _ = file_system(self.path)
        system.create_dir(inside, recursive=True)
        if overwrite:
            system.delete_dir_contents(inside)

    def write(self, rows) -> WriterCommitMessage:
        system, inside, _ = file_system(self.path)
        made = set()
        for row in rows:
            if row["name"] is None or row["content"] is None:
                continue
            if "/" in row["name"] or row["name"].startswith((".", "_")):
                raise ValueError(f"not a file name: {row['name']!r}")
            folder = f"{inside}/{zlib.crc32(row['name'].encode()) % self.folders:06d}" if self.folders else inside
            if self.folders and folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4()}"
            with system.open_output_stream(hidden) as out:
                out.write(bytes(row["content"]))
            system.move(hidden, f"{folder}/{row['name']}")
        return WriterCommitMessage()


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source `photo_files`."""
    spark.dataSource.register(PhotoFiles)
    return spark
