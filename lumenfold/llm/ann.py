"""Approximate nearest neighbours by inner product, with balanced posting lists.

1. Vectors become points of one more dimension, x / M and what is missing to length 1 (M is the largest length), so that the
   largest inner products with a query are the smallest distances to its direction.
2. Centroids are fitted on a sample of `SAMPLE` points at most: k-means whose assignment charges a price for crowded clusters,
   in two levels, so that lists come out about as long. Their number is half the square root of the rows, `MOST_LISTS` at most.
3. A graph links each centroid to its near ones, without those that a nearer neighbour stands for, and so that all can be reached. It is
   held in memory by every task (its size is bounded by `MOST_LISTS` and `CENTROID_VALUES`); lists are found by a beam search
   over it, for a batch of points at a time.
4. Every vector is posted to its nearest list, and, if it lies near a boundary, to others: those within (1 + `CLOSURE`) of the nearest
   distance, but for lists that lie nearer to one that is taken already than to the vector; `REPLICAS` at most.
5. A query searches the lists within (1 + ratio) of its nearest one's distance, so queries in a clear place search few and those between
   clusters search many; the beam grows until it holds all of them. The ratio is measured, on every table: some queries
   (`TRIED`) are answered exactly, against all rows, and the ratio is what brings in `RECALL` of their neighbours. A query whose
   lists have too few rows for k neighbours takes the next ones too, and one that still finds fewer searches all.
6. Lists are cut into blocks of `BLOCK` rows by a hash of the id, so that no task holds a list of any size; each block scores its
   queries as matrix products, and the hopeful pairs once more, exactly, in order of the components. Tasks keep the best of each query.

Recall is over 0.9 by measurement of step 5; what is found has exact scores. On vectors without any structure, as those of
`embeddings` nearly are, neighbours lie all around and the ratio says that a good part of the lists must be searched.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components, and null ids, take no part; vectors
of several lengths share the index (shorter ones are filled up with zeros for it), and only those of the query's length are its
candidates; rows that repeat an id with the same score count once, and none is a candidate of its own id; of a query's id that
repeats, the smallest vector asks; equal vectors have equal scores, and ties go to the smaller id; pairs whose score is no
number (beyond the range of double) count as none; a table without rows gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint, shared_table

SAMPLE, SAMPLE_VALUES = 32_768, 1 << 24
MOST_LISTS, CENTROID_VALUES = 4096, 1 << 22
CLOSURE, REPLICAS = 0.03, 4
TRIED, RECALL = 256, 0.95
BLOCK, ASKED, KEPT = 4096, 1024, 1 << 18
LINKS, BEAM, ENTRIES = 24, 24, 8


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared, of all pairs."""
    out = (points * points).sum(axis=1)[:, None] + (others * others).sum(axis=1)[None, :] - 2 * (points @ others.T)
    return np.maximum(out, 0, out=out)


def balanced_means(points: np.ndarray, count: int, random: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the cluster of each point): k-means in which a crowded cluster costs more."""
    centres = points[random.choice(len(points), min(count, len(points)), replace=False)]
    price, own = np.zeros(len(centres)), np.zeros(len(points), np.int64)
    for _ in range(rounds):
        far = distances(points, centres)
        own = (far + price).argmin(axis=1)
        sizes = np.bincount(own, minlength=len(centres))
        price += 0.1 * far.min(axis=1).mean() * (sizes * len(centres) / len(points) - 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres, own


def fit_centroids(points: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """`count` centroids of balanced clusters, of length 1 as the points; by way of some large clusters if there are many."""
    random = np.random.default_rng(seed)
    points = points[random.permutation(len(points))]
    count = max(1, min(count, len(points)))
    if count <= 64:
        out = [balanced_means(points, count, random)[0]]
    else:
        top, out = balanced_means(points, int(count**0.5), random)[1], []
        for c in np.unique(top):
            part = points[top == c]
            out.append(balanced_means(part, max(1, round(count * len(part) / len(points))), random)[0])
    means = np.concatenate(out)
    return means / np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-300)


@dataclass
class CentroidGraph:
    """Centroids, the neighbours of each (filled up with -1), and where a search begins."""

    centres: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(centres: np.ndarray, most: int = LINKS) -> CentroidGraph:
        n = len(centres)
        near: list[set[int]] = [set() for _ in range(n)]
        for start in range(0, n, 512):
            far = distances(centres[start : start + 512], centres)
            far[np.arange(len(far)), start + np.arange(len(far))] = np.inf
            order = np.argsort(far, axis=1, kind="stable")[:, : 2 * most]
            for k, row in enumerate(order.tolist()):
                taken: list[int] = []
                for x in row:
                    if x != start + k and len(taken) < most // 2 and (not taken or far[k, x] < distances(centres[[x]], centres[taken]).min()):
                        taken.append(x)
                near[start + k] |= set(taken)
                for x in taken:
                    if len(near[x]) < most:
                        near[x].add(start + k)
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
        seen, due = set(entries.tolist()), entries.tolist()
        while len(seen) < n:
            while due:
                fresh = near[due.pop()] - seen
                seen |= fresh
                due += fresh
            if len(seen) < n:  # a part that no link leads to is linked from its nearest neighbour
                out, inside = np.array(sorted(set(range(n)) - seen)), np.array(sorted(seen))
                at = int(out[0])
                near[int(inside[distances(centres[[at]], centres[inside])[0].argmin()])].add(at)
                seen.add(at)
                due.append(at)
        links = np.full((n, max(1, max(map(len, near)))), -1)
        for k, own in enumerate(near):
            links[k, : len(own)] = sorted(own)
        return CentroidGraph(centres, links, entries)

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids that the beam finds for each point, nearest first, and their squared distances. -1 where there are fewer."""
        n = len(points)
        width = min(width, len(self.centres))
        seen = np.zeros((n, len(self.centres)), bool)
        seen[:, self.entries] = True
        held = np.tile(self.entries, (n, 1))
        far = distances(points, self.centres[self.entries])
        done = np.zeros(held.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            held, far, done = (np.take_along_axis(x, order, axis=1) for x in (held, far, done))
            open_ = np.where(done | ~np.isfinite(far), np.inf, far)
            going = np.flatnonzero(np.isfinite(open_).any(axis=1))
            if not len(going):
                return np.where(np.isfinite(far), held, -1), far
            first = np.argsort(open_[going], axis=1, kind="stable")[:, :4]
            real = np.isfinite(np.take_along_axis(open_[going], first, axis=1))
            done[going[:, None], first] |= real
            found = np.where(real[:, :, None], self.links[held[going[:, None], first]], -1).reshape(len(going), -1)
            found = np.sort(found, axis=1)
            fresh = (found >= 0) & ~seen[going[:, None], np.maximum(found, 0)]
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            at, k = np.nonzero(fresh)
            new = found[at, k]
            seen[going[at], new] = True
            gap = points[going[at]] - self.centres[new]
            wide = np.full((n, fresh.sum(axis=1).max(initial=0)), -1)
            place = np.cumsum(fresh, axis=1)[at, k] - 1
            wide_far = np.full(wide.shape, np.inf)
            wide[going[at], place], wide_far[going[at], place] = new, np.einsum("ij,ij->i", gap, gap)
            held, far, done = np.concatenate([held, wide], axis=1), np.concatenate([far, wide_far], axis=1), np.concatenate([done, np.zeros(wide.shape, bool)], axis=1)


def within(graph: CentroidGraph, points: np.ndarray, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
    """For each point the centroids at (1 + `ratio`) times its nearest one's distance or less, and more if these have fewer than `least` rows.

    The beam grows until it holds all of them. `sizes` has the rows of each list.
    """
    sizes = np.zeros(len(graph.centres), np.int64) if sizes is None else sizes
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(points)
    due, width = np.arange(len(points)), BEAM
    while len(due):
        left = []
        for start in range(0, len(due), 256):
            own = due[start : start + 256]
            held, far = graph.search(points[own], width)
            reach = (np.sqrt(far[:, :1]) * (1 + ratio)) ** 2 * (1 + 1e-12)
            before = np.cumsum(np.where(held >= 0, sizes[held], 0), axis=1) - np.where(held >= 0, sizes[held], 0)
            fine = ((far <= reach) | (before < least)) & (held >= 0)
            for k, row in zip(own.tolist(), range(len(own))):
                if fine[row].all() and width < len(graph.centres):
                    left.append(k)
                else:
                    out[k] = held[row][fine[row]]
        due, width = np.array(left, np.int64), 4 * width
    return out


def postings(graph: CentroidGraph, points: np.ndarray, closure: float = CLOSURE, replicas: int = REPLICAS) -> list[list[int]]:
    """The lists of each vector: its nearest one and those across a near boundary."""
    out: list[list[int]] = []
    for start in range(0, len(points), 512):
        held, far = graph.search(points[start : start + 512], max(BEAM, replicas))
        for row, gaps in zip(held[:, :replicas].tolist(), far[:, :replicas].tolist()):
            taken = [row[0]]
            for x, gap in zip(row[1:], gaps[1:]):
                if x < 0 or gap > gaps[0] * (1 + closure) ** 2:
                    break
                if gap < distances(graph.centres[[x]], graph.centres[taken]).min():
                    taken.append(x)
            out.append(taken)
    return out


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as doubles, filled up with zeros."""
    column = batch.column("vector")
    ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64)
    out, sizes = np.zeros((batch.num_rows, width)), np.diff(ends)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    most = max(1, (1 << 22) // max(1, width))
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def as_points(vectors: np.ndarray, longest: float) -> np.ndarray:
    short = vectors / longest
    return np.concatenate([short, np.sqrt(np.maximum(0, 1 - (short * short).sum(axis=1)))[:, None]], axis=1)


def as_directions(vectors: np.ndarray) -> np.ndarray:
    safe = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.concatenate([safe / np.sqrt((safe * safe).sum(axis=1, keepdims=True)), np.zeros((len(safe), 1))], axis=1)


def _best(queries: np.ndarray, vectors: np.ndarray, barred: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the `k` highest scores of each query, ties to the smaller id, without `barred` pairs and equal (id, score).

    A fast product finds who could be among them; their scores are then summed component by component, in order.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ vectors.T
        room = 1e-12 * np.sqrt((queries * queries).sum(axis=1))[:, None] * np.sqrt((vectors * vectors).sum(axis=1))[None, :]
    rough[barred] = -np.inf
    odd = ~np.isfinite(rough) & ~barred
    copies = 4 * k  # an id may repeat
    if len(ids) > copies:
        least = np.partition(np.where(odd, -np.inf, rough - np.where(np.isfinite(room), room, 0)), len(ids) - copies, axis=1)[:, [len(ids) - copies]]
        hopeful = (rough + room >= least) | odd
    else:
        hopeful = np.ones(rough.shape, bool)
    if len(np.unique(ids)) < len(ids):
        hopeful = np.ones(rough.shape, bool)
    q, x = np.nonzero(hopeful & ~barred)
    scores = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(queries.shape[1]):
            scores += queries[q, j] * vectors[x, j]
    return _first(q, ids[x], scores, k, x)


def _first(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id or place, score) of the first `k` of each query; pairs without a number and repeated (id, score) go."""
    order = np.lexsort((ids, -scores, query))
    order = order[~np.isnan(scores[order])]
    q, i, s = query[order], ids[order], scores[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    order, q = order[fresh], q[fresh]
    begins = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    turn = np.arange(len(q)) - np.maximum.accumulate(np.where(begins, np.arange(len(q)), 0))
    order = order[turn < k]
    return query[order], (ids if place is None else place)[order], scores[order]


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, size) of the rows that take part."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    if not own.schema["vector"].dataType.elementType.typeName() == "float":
        own = own.withColumn("vector", F.col("vector").cast("array<double>"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return own.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine).withColumn("size", F.size("vector"))


def _tried(rows: DataFrame, asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, width: int) -> list[tuple[int, list[int]]]:
    """(query, lists) of the true neighbours of some queries (ids, sizes, vectors), of all rows with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, queries = asked
        for batch in batches:
            for part in _parts(batch, width):
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                barred = (ids[:, None] == own[None, :]) | (sizes[:, None] != part.column("size").to_numpy(zero_copy_only=False)[None, :])
                q, x, scores = _best(queries, _vectors(part, width), barred, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(own[x]), pa.array(scores), part.column("lists").take(pa.array(x))], names=["query", "vec_id", "score", "lists"])

    found = rows.select("vec_id", "size", "vector", "lists").mapInArrow(run, "query int, vec_id long, score double, lists array<int>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query", "vec_id", "score").agg(F.min("lists").alias("lists")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return [(r["query"], r["lists"]) for r in best.select("query", "lists").collect()]  # k rows for each of TRIED queries


def measured_ratio(graph: CentroidGraph, directions: np.ndarray, neighbours: list[tuple[int, list[int]]], recall: float = RECALL) -> float:
    """The smallest ratio that brings in `recall` of the true neighbours."""
    if not neighbours:
        return 0.0
    far = np.sqrt(distances(directions, graph.centres))
    nearest = np.maximum(far.min(axis=1), 1e-300)
    needed = np.sort([far[q, lists].min() / nearest[q] - 1 for q, lists in neighbours])
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) * (1 + 1e-9)


def _searched(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by list, block and size, first the data, then the queries. What is found is kept until it is `KEPT` rows, and then cut to the best `k` of each query."""
        key: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answer() -> None:
            if held and asked:
                if len(held) > 1:
                    held[:] = [tuple(np.concatenate(x) for x in zip(*held))]
                ids, vectors = held[0]
                query_ids, queries = (np.concatenate(x) for x in zip(*asked))
                for start in range(0, len(query_ids), ASKED):
                    own = query_ids[start : start + ASKED]
                    q, x, scores = _best(queries[start : start + ASKED], vectors, own[:, None] == ids[None, :], ids, k)
                    found.append((own[q], ids[x], scores))
            asked.clear()

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            if found and (last or sum(len(x[0]) for x in found) > KEPT):
                found[:] = [_first(*(np.concatenate(x) for x in zip(*found)), k)]
                if last or len(found[0][0]) > KEPT // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["query_id", "vec_id", "score"])
                    found.clear()

        for batch in batches:
            for part in _parts(batch, width):
                keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "size", "asks")])
                ids, vectors = part.column("vec_id").to_numpy(zero_copy_only=False), _vectors(part, width)
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for start, stop in zip([0, *cuts], [*cuts, part.num_rows] if part.num_rows else []):
                    if tuple(keys[:3, start]) != key:
                        answer()
                        yield from told(False)
                        key = tuple(keys[:3, start])
                        held.clear()
                    (asked if keys[3, start] else held).append((ids[start:stop], vectors[start:stop]))
                    if keys[3, start] and sum(len(x) for x, _ in asked) >= ASKED:
                        answer()
                        yield from told(False)
        answer()
        yield from told(True)

    return run


def _listed(df: DataFrame, width: int, lists, name: str) -> DataFrame:
    """`df` (vec_id, size, vector) with an array of lists, which `lists` makes from a table of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, width):
                found = pa.array([list(map(int, x)) for x in lists(_vectors(part, width))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    kind = df.schema["vector"].dataType.simpleString()
    return df.select("vec_id", "size", "vector").mapInArrow(run, f"vec_id long, size int, vector {kind}, {name} array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the `k` highest inner products that are found for each query among all vectors but its own."""
    data = _clean(vectors, id_col, vector_col)
    asking = _clean(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    count, width, length, most = data.agg(F.count("*"), F.max("size"), F.sqrt(F.max(square)), F.max(largest)).first()
    if not count:
        return asking.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where(F.lit(False))
    longest = length if 0 < length < float("inf") else min(float(most) * width**0.5, 1.7e308)

    held = min(SAMPLE, max(64, SAMPLE_VALUES // (width + 1)))
    turn = F.xxhash64(F.lit("fit"), "vec_id")
    near = data if count <= held else data.where(F.pmod(turn, F.lit(1 << 40)) <= int((1 << 40) * min(1.0, 1.2 * held / count)))
    sample = near.orderBy(turn, "vec_id").limit(held).select("vector").toArrow()
    points = np.concatenate([as_points(_vectors(b, width), longest) for b in sample.to_batches()])
    lists = max(1, min(MOST_LISTS, CENTROID_VALUES // (width + 1), round(count**0.5 / 2)))
    graph = data.sparkSession.sparkContext.broadcast(CentroidGraph.of(fit_centroids(points, lists)))

    posted = shared_table(_listed(data, width, lambda v: postings(graph.value, as_points(v, longest)), "lists"))
    few = asking.orderBy(F.xxhash64(F.lit("try"), "vec_id"), "vec_id").limit(max(1, min(TRIED, SAMPLE_VALUES // (width + 1)))).toArrow()
    own = [(b.column("vec_id").to_numpy(zero_copy_only=False), b.column("size").to_numpy(zero_copy_only=False), _vectors(b, width)) for b in few.to_batches() if b.num_rows]
    if own:
        tried = tuple(np.concatenate(x) for x in zip(*own))
        ratio = measured_ratio(graph.value, as_directions(tried[2]), _tried(posted, tried, k, width), recall)
    else:
        ratio = 0.0
    rows = posted.select(F.explode("lists").alias("list"), "vec_id", "size", "vector")
    held_rows = np.zeros(len(graph.value.centres), np.int64)
    for r in rows.groupBy("list").count().collect():  # a row for each list
        held_rows[r["list"]] = r["count"]
    blocks = F.element_at(F.lit(np.maximum(1, -(-held_rows // block)).tolist()).cast("array<int>"), F.col("list") + 1)
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id"), blocks).cast("int"), "asks": F.lit(0)})

    def search(asks: DataFrame) -> DataFrame:
        own = asks.select(F.explode("lists").alias("list"), "vec_id", "size", "vector")
        met = dealt.unionByName(own.withColumns({"block": F.explode(F.sequence(F.lit(0), blocks - 1)), "asks": F.lit(1)}))
        met = met.repartition("list", "block").sortWithinPartitions("list", "block", "size", "asks")
        return shared_checkpoint(met.select("list", "block", "size", "asks", "vec_id", "vector").mapInArrow(_searched(k, width), "query_id long, vec_id long, score double")).distinct()

    found = search(_listed(asking, width, lambda v: within(graph.value, as_directions(v), ratio, held_rows, 4 * k), "lists"))
    # copies, lengths and repeated ids may still leave a query with fewer than k: those search everything
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = shared_checkpoint(asking.join(enough, "vec_id", "left_anti"))
    if count > k and not short.isEmpty():
        every = search(short.withColumn("lists", F.sequence(F.lit(0), F.lit(len(held_rows) - 1))))
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(every)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
