"""Exact top-k search by inner product with a dual tree of cover trees.

Data vectors are dealt by a hash of their id into blocks of `BLOCK` vectors or `BLOCK_VALUES` components on average; every
query meets every block (a stated query set against all rows, in blocks). A task indexes its block in one cover tree, then
takes the queries that stream in, `QUERIES` at a time, indexes them in a second one, and walks both: a pair of nodes is pruned if

    <q, x> + rq |x| + rx |q| + rq rx  <  the worst kth score of the queries in q

where q and x are the nodes' centres and rq and rx their covering radii, with a margin for rounding. At equal scores the
smaller id wins, so a pair that could only tie is searched too. The base of the tree, by which radii shrink, is chosen at each
node from the spread that is measured there; points that no smaller ball gathers stay one leaf, as bounds could prune none
of them. Each block returns its best k for each query, and a window over those few rows picks the final ones. Memory is
bounded by the block; only the queries are replicated.

Scores are whole numbers and exact: in floating point while |q| |x| is under 2^53, in 64-bit integers while it is under 2^63, and
beyond that in integers of any length. A score that no long can hold travels with its sign and its digits as bytes that sort as it
does, so that scores are ranked rightly at any size; in the end it is shown as the largest or smallest long.

Nulls and edge cases: vectors that are null or hold null or non-finite components, and null ids, take no part; only vectors
of the query's length are its candidates; copies of a vector are searched as k + 1 of them with the smallest ids
(the others could never be among a query's best k); rows with the same id count each, and none is a candidate of its own id;
an empty table gives an empty result; other columns play no part. Components may be of any size: `quantized` keeps them as
doubles, which hold floor(scale * x) exactly; only where scale * x is no finite double (x over 7e305), the vector takes no part.
Where lengths leave the range of double no bound can be told, and nothing is pruned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BLOCK_VALUES, QUERIES, LEAF = 8192, 1 << 20, 1024, 24
#: By how much radii shrink from a node to its children; the first that gathers points is taken.
BASES = (2.0, 1.4)
NONE = np.iinfo(np.int64).min


@dataclass
class CoverTree:
    """Nodes by number: centre, covering radius, children, and the points below."""

    points: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    children: list[np.ndarray]
    members: list[np.ndarray]


def cover_tree(vectors: np.ndarray) -> CoverTree:
    """Top down: the points of a node are covered by smaller balls about some of them, until few are left, all are equal, or balls gather nothing.

    Each ball's centre is further than the balls' radius from the centres before it.
    """
    points = vectors.astype(np.float64)
    centres, radii, children, members = [], [], [], []

    def apart(centre: int, own: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            gap = points[own] - points[centre]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 + 1e-9)

    def add(centre: int, own: np.ndarray, far: np.ndarray) -> int:
        centres.append(centre)
        radii.append(float(far.max(initial=0)))
        children.append(np.zeros(0, np.int64))
        members.append(own)
        return len(centres) - 1

    def cover(centre: int, own: np.ndarray, far: np.ndarray, reach: float, most: int) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
        """(centre, points, their distances) of each ball; None if there are more than `most`."""
        balls, rest = [], own
        while len(rest):
            near = far <= reach
            balls.append((centre, rest[near], far[near]))
            rest = rest[~near]
            if len(balls) > most or len(rest) > len(own) - len(balls) * len(own) / (2 * most) and len(balls) > most // 4:
                return None
            if len(rest):
                centre = int(rest[0])
                far = apart(centre, rest)
        return balls

    due = [add(0, np.arange(len(points)), apart(0, np.arange(len(points))))] if len(points) else []
    while due:
        node = due.pop()
        own, centre = members[node], centres[node]
        if len(own) <= LEAF or radii[node] == 0 or not np.isfinite(radii[node]):
            continue
        far, few = apart(centre, own), own[:: max(1, len(own) // 128)]
        for base in BASES:
            reach = radii[node] / base
            if len(few) < len(own) and cover(centre, few, apart(centre, few), reach, max(4, len(few) // 2)) is None:
                continue
            balls = cover(centre, own, far, reach, max(4, len(own) // 4))
            if balls is not None:
                children[node] = np.array([add(*ball) for ball in balls])
                due += children[node].tolist()
                break
    centre_points = points[centres] if centres else points
    with np.errstate(over="ignore"):
        norms = np.sqrt((centre_points * centre_points).sum(axis=1)) * (1 + 1e-9)
    return CoverTree(vectors, centre_points, np.array(radii), norms, children, members)


def longest(vectors: np.ndarray) -> float:
    """An upper bound of the lengths of some vectors of whole numbers."""
    floats = vectors.astype(np.float64)
    with np.errstate(over="ignore"):
        return float(np.sqrt((floats * floats).sum(axis=1)).max(initial=0)) * (1 + 1e-9)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """As integers of any length."""
    return np.array([[int(x) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def _float(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return math.copysign(math.inf, score)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two tables of whole numbers, exactly; of type object where a product could leave 64 bits."""
    size = longest(a) * longest(b)
    if size < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T if size < 2**63 else _integers(a) @ _integers(b).T


def carried(scores: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(side, digits, score): 1 or -1 for scores above or below the range of long, and bytes that sort as they do; else 0 and null. `score` stays in range."""
    if scores.dtype != object:
        return pa.array(np.zeros(len(scores), np.int32)), pa.nulls(len(scores), pa.binary()), pa.array(scores)
    sides, digits, shown = [], [], []
    for x in scores.tolist():
        side = (x > 2**63 - 1) - (x < -(2**63))
        size = (abs(x).bit_length() + 7) // 8
        told = size.to_bytes(2, "big") + abs(x).to_bytes(size, "big") if side else None
        sides.append(side)
        digits.append(bytes(255 - b for b in told) if side < 0 else told)
        shown.append(max(-(2**63), min(2**63 - 1, x)))
    return pa.array(sides, pa.int32()), pa.array(digits, pa.binary()), pa.array(shown, pa.int64())


def dual_search(data: CoverTree, data_ids: np.ndarray, queries: CoverTree, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query its `k` best scores and their places in `data_ids` (which is in order), best first, and how many pairs were compared.

    Places are -1 where there are fewer. Scores are of type object if any could leave 64 bits.
    """
    wide = not longest(data.points) * longest(queries.points) < 2**63
    best, places = np.full((len(query_ids), k), NONE, object if wide else np.int64), np.full((len(query_ids), k), -1)
    leaf = np.array([len(c) == 0 for c in data.children])
    compared = 0

    def worst(own: np.ndarray) -> float:
        return -np.inf if (places[own, k - 1] < 0).any() else _float(best[own, k - 1].min())

    def bounds(node: int, others: np.ndarray) -> np.ndarray:
        ball, size = queries.radii[node], queries.norms[node]
        with np.errstate(over="ignore", invalid="ignore"):
            room = ball * data.norms[others] + data.radii[others] * size + ball * data.radii[others]
            bound = data.centres[others] @ queries.centres[node] + room + 1e-9 * (1 + room + size * data.norms[others])
        return np.where(np.isnan(bound), np.inf, bound)

    def compare(own: np.ndarray, found: np.ndarray) -> None:
        nonlocal compared
        for start in range(0, len(found), 2048):
            part = np.sort(found[start : start + 2048])
            compared += len(own) * len(part)
            scores = exact_scores(queries.points[own], data.points[part])
            other = query_ids[own][:, None] != data_ids[part][None, :]
            full = places[own, k - 1] >= 0
            hopeful = other & (~full[:, None] | (scores >= best[own, k - 1][:, None]))
            for row in np.flatnonzero(hopeful.any(axis=1)).tolist():
                at, query = np.flatnonzero(hopeful[row]), own[row]
                held = places[query] >= 0
                new, where = np.concatenate([best[query][held], scores[row, at]]), np.concatenate([places[query][held], part[at]])
                if wide:
                    order = nlargest(k, range(len(new)), key=lambda i: (new[i], -where[i]))
                else:
                    least = np.partition(new, len(new) - k)[len(new) - k] if len(new) > k else NONE
                    kept = np.flatnonzero(new >= least)
                    order = kept[np.lexsort((where[kept], ~new[kept]))][:k]
                best[query, : len(order)], places[query, : len(order)] = new[order], where[order]

    def walk(node: int, others: np.ndarray) -> None:
        """Compare the queries of `node` with all points below the data nodes `others`."""
        own = queries.members[node]
        while len(others):
            bound = bounds(node, others)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] >= worst(own)]
            others = others[order]
            split = others[~leaf[others] & (data.radii[others] >= queries.radii[node])]
            if len(split):
                others = np.concatenate([others[leaf[others] | (data.radii[others] < queries.radii[node])], *(data.children[x] for x in split)])
            elif len(queries.children[node]):
                for child in queries.children[node]:
                    walk(int(child), others)
                return
            else:
                inner = others[~leaf[others]]
                if len(inner):
                    others = np.concatenate([others[leaf[others]], *(data.children[x] for x in inner)])
                    continue
                first, others = others[:16], others[16:]
                if len(first):
                    compare(own, np.concatenate([data.members[x] for x in first]))

    if len(data_ids) and len(query_ids):
        walk(0, np.array([0]))
    return best, places, compared


def _first_copies(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each group of equal vectors; ids are in order."""
    order = np.lexsort((np.arange(len(ids)), *vectors.T)) if vectors.shape[1] else np.arange(len(ids))
    ordered = vectors[order]
    begins = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
    return np.sort(order[place < most])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, first its data, then queries."""
        key: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        tree, ids = None, np.zeros(0, np.int64)

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ids, asked
            if not asked:
                return
            if tree is None:
                ids, vectors = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), asked[0][1][:0])
                kept = _first_copies(vectors, ids, k + 1)
                ids, tree = ids[kept], cover_tree(vectors[kept])
            query_ids, vectors = (np.concatenate(x) for x in zip(*asked))
            asked = []
            for start in range(0, len(query_ids), QUERIES):
                own = query_ids[start : start + QUERIES]
                best, places, _ = dual_search(tree, ids, cover_tree(vectors[start : start + QUERIES]), own, k)
                row, rank = np.nonzero(places >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[places[row, rank]]), *carried(best[row, rank])], names=["query_id", "vec_id", "side", "digits", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, size, asks, vec_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "size", "asks", "vec_id"))
            flat, ends = batch.column("vector").values.to_numpy(zero_copy_only=False), batch.column("vector").offsets.to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (size[1:] != size[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if (int(block[start]), int(size[start])) != key:
                    yield from answer()
                    key, held, tree = (int(block[start]), int(size[start])), [], None
                rows = vec_ids[start:stop].astype(np.int64), flat[ends[start] : ends[stop]].reshape(stop - start, int(size[start]))
                (asked if asks[start] else held).append(rows)
                if asks[start] and sum(len(x) for x, _ in asked) >= QUERIES:
                    yield from answer()
        yield from answer()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the `k` highest inner products of each query among all vectors but its own.

    Both tables hold an id and an array of whole numbers (long, or double beyond its range); queries are found again in the data by their id.
    """
    kind = "double" if "double" in (vectors.schema[vector_col].dataType.elementType.typeName(), queries.schema[vector_col].dataType.elementType.typeName()) else "long"

    def rows(df: DataFrame) -> DataFrame:
        own = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast(f"array<{kind}>").alias("vector"))
        return own.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).withColumn("size", F.size("vector"))

    data = rows(vectors)
    count, values = data.agg(F.count("*"), F.sum("size")).first()
    blocks = max(1, -(-count // block), -(-(values or 0) // BLOCK_VALUES))
    dealt = data.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "asks": F.lit(False)})
    asking = rows(queries).withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(True)})
    met = dealt.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "size", "asks", "vec_id")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, side int, digits binary, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each component x as floor(scale * x), a double; vectors that are null or hold null components, or ones that are not finite after scaling, go."""

    def scaled(x: Column) -> Column:
        return x.cast("double") * scale

    def floored(x: Column) -> Column:
        return F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))  # from there on doubles are whole

    fine = F.forall(vectors[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    return vectors.where(vectors[vector_col].isNotNull() & fine).select(vectors[id_col].alias("vec_id"), F.transform(vectors[vector_col], floored).alias("vector"))
