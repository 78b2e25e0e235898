"""Connected components of an edge table, by DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint

#: Edges that a task contracts at a time, whatever the size of its partition.
CHUNK = 100_000


def components(edges: DataFrame, within: str | None = None) -> DataFrame:
    """(node, component) for each node of `edges` (a, b: of one orderable type); a component is named by its smallest node.

    First each task contracts the edges that it has, a chunk at a time, so that a component that lies in one chunk is a
    finished star. If one chunk held all edges that is the result. Else alternating stars: each node hangs its larger
    neighbours (large star) and then its smaller ones (small star) onto the smallest node it knows, until nothing changes; a
    logarithmic number of rounds in practice. Each round is two aggregations with map-side combining (the minimum) and a
    join; a node with many edges is never gathered into one row. Self-links, repeated edges and edges with a null end are
    allowed and change nothing.

    `within` names a field of the nodes that linked nodes have in common. Edges of one value of it are then contracted together, once,
    where there are no more of them than a chunk has; only values with more go through the rounds.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = shared_checkpoint(links if within else links.distinct())
    count = links.count()
    if count <= CHUNK:
        return _named(shared_checkpoint(_contracted(links.coalesce(1))))
    if within is None:
        return _named(_starred(links))
    keyed = links.withColumn("g", F.xxhash64(f"a.{within}"))
    large = shared_checkpoint(keyed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("g"))  # no more than one for each chunk
    parts = max(links.sparkSession.sparkContext.defaultParallelism, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = keyed.join(F.broadcast(large), "g", "left_anti").repartition(parts, "g").sortWithinPartitions("g")
    stars = shared_checkpoint(_contracted(small))
    if not large.isEmpty():
        stars = stars.unionByName(_starred(keyed.join(F.broadcast(large), "g", "left_semi").select("a", "b").distinct()))
    return _named(stars)


def _starred(links: DataFrame) -> DataFrame:
    """Links (a, b: the smaller one) as stars, by rounds."""
    links = shared_checkpoint(_contracted(links).distinct())
    seen = _print_of(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        links = shared_checkpoint(small.where("a <> b").distinct())
        now = _print_of(links)
        if now == seen:
            return links
        seen = now


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _print_of(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def stars_of(edges: list[tuple]) -> list[tuple]:
    """(node, smallest node of its component) for all but the smallest ones, from edges between plain values."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def _leaves(values: pa.Array) -> Iterator[pa.Array]:
    """Columns that order rows as Spark orders `values`: structs by their fields, nulls first, NaN last."""
    if values.null_count:
        yield values.is_valid().cast(pa.int8())
    if pa.types.is_struct(values.type):
        for field in values.flatten():
            yield from _leaves(field)
    elif pa.types.is_floating(values.type):
        yield pc.is_nan(values).cast(pa.int8())
        yield pc.if_else(pc.is_nan(values), 0.0, values)
    else:
        yield values.cast(pa.int8()) if pa.types.is_boolean(values.type) else values


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct value is first, in order; which of these each value is)."""
    code = np.zeros(len(values), np.int64)
    first = code[:1]
    for leaf in _leaves(values):
        rank = pc.rank(leaf, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        _, first, code = np.unique(code * (len(rank) + 1) + rank, return_index=True, return_inverse=True)
    return first, code


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one of its component, from links a to b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def _contracted(links: DataFrame) -> DataFrame:
    """A star for each component of each chunk. Where rows have `g`, in order, no chunk ends between two of one `g`."""
    grouped = "g" in links.columns

    def contract(rows: pa.Table) -> pa.RecordBatch:
        ends = pa.concat_arrays([c for k in ("a", "b") for c in rows.column(k).chunks])
        first, code = _codes(ends)
        label = least_reached(code[: rows.num_rows], code[rows.num_rows :], len(first))
        found = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([ends.take(pa.array(first[x])) for x in (found, label[found])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = batch.num_rows
            if grouped:
                g = batch.column("g").to_numpy()
                last = np.flatnonzero(np.append(held[-1].column("g")[-1].as_py() if held else g[0], g[:-1]) != g)
                cut = int(last[-1]) if len(last) else -1  # before its last group
            if cut >= 0 and sum(b.num_rows for b in held) + cut >= CHUNK:
                yield contract(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield contract(pa.Table.from_batches(held))

    return links.mapInArrow(run, links.select("a", "b").schema)
