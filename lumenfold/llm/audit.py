"""Filter interaction audit: what each of five filters removes, after any others, from counts of failure masks.

1. Each text gives four flags (A to D below), and a digest of the whole text; these small rows are written to the shared folder.
2. A counting Bloom sketch finds the texts that could be repeats: each task counts its digests in a sparse sketch (`PROBES`
   counters in one block of `BLOCK`, stopped at two), tasks' sketches are added up by chunk, and what is left is a bit for each
   counter that reached two. A text with a counter below two is the only one of its kind. The bits are broadcast: 32 MB at most
   (`MOST_COUNTERS`), whatever the corpus; past some 30 million texts they clear fewer, and more digests shuffle.
3. Only possible repeats shuffle: the smallest id of each digest, summed up in each task first, so that a text of any number
   of copies is one row a task. Failing E are those of them that aren't at their text's smallest id, found by a join on id and digest.
4. Counts by mask are additive: all rows are counted as if none failed E, and the repeats are then moved from their mask to
   that with E. So 32 counts for each part, with those of labelled documents, are all that the 120 orders need.

The filters, as failure conditions: A, under 100 words; B, 100 * distinct words < 80 * words; C, 100 * `[A-Z]` > 10 * code points;
D, any of `#$%&*|`; E, identical to the text of a smaller id anywhere in the table.

Nulls and edge cases: a null text counts as empty, and a null part as the empty one; rows with a null id pass E and make no
others fail it; rows with the same id are never smaller than each other, so that equal ones all pass, and each counts; a
label counts once for each row of its document, whatever other labels the document has; texts are taken whole; a table without
rows gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint, shared_table
from lumenfold.functions.scalar import bound

FILTERS = "ABCDE"
BLOCK, CHUNK, PROBES = 512, 1 << 16, 4
LEAST_COUNTERS, COUNTERS_A_ROW, MOST_COUNTERS = 1 << 16, 8, 1 << 28
#: Digests that a task counts at a time.
HELD = 500_000


def failing(text: Column) -> Column:
    """The failures of A to D as bits 0 to 3."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 100, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), 2).otherwise(0)

    words = bound(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), of_words)
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"), 4).otherwise(0)
    return words + capitals + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _counters(rows: int) -> int:
    """How many counters a sketch of so many rows has, a power of two."""
    return max(LEAST_COUNTERS, min(MOST_COUNTERS, 1 << max(0, COUNTERS_A_ROW * rows - 1).bit_length()))


def _places(h: Column | np.ndarray, k: int):
    """Which counter of its block the `k`th probe of a hash is: 9 of its bits. The block comes of the bits above."""
    return F.shiftright(h, 9 * k).bitwiseAND(F.lit(BLOCK - 1)) if isinstance(h, Column) else h >> 9 * k & BLOCK - 1


def _block(h: Column, counters: int) -> Column:
    return F.shiftrightunsigned(h, 36).bitwiseAND(F.lit(counters // BLOCK - 1))


def sketch(hashes: DataFrame, counters: int) -> DataFrame:
    """(block, bits) of the blocks in which a counter reached two; `bits` are 8 longs, a bit for each counter. `hashes` has h (long)."""
    blocks = np.int64(counters // BLOCK - 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            h = np.concatenate(held)
            base = (h >> 36 & blocks) * BLOCK
            # a probe that meets another one of its row counts once
            own = np.sort(np.stack([base + _places(h, k) for k in range(PROBES)], axis=1), axis=1)
            fresh = np.concatenate([np.ones((len(h), 1), bool), own[:, 1:] != own[:, :-1]], axis=1)
            places, counts = np.unique(own[fresh], return_counts=True)
            marks = (places % CHUNK << 2 | np.minimum(counts, 2)).astype(np.uint32)
            chunks, starts = np.unique(places // CHUNK, return_index=True)
            ends = np.append(starts[1:], len(marks))
            return pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([marks[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["chunk", "marks"])

        for batch in batches:
            held.append(batch.column("h").to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk."""
        chunk, counts = None, np.zeros(CHUNK, np.uint8)

        def told() -> pa.RecordBatch:
            bits = np.packbits(counts >= 2, bitorder="little").view("<i8").reshape(-1, BLOCK // 64)
            full = np.flatnonzero(bits.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(chunk * (CHUNK // BLOCK) + full), pa.array(bits[full].tolist(), pa.list_(pa.int64()))], names=["block", "bits"])

        for batch in batches:
            for own, marks in zip(batch.column("chunk").to_pylist(), batch.column("marks")):
                if own != chunk:
                    if chunk is not None:
                        yield told()
                    chunk, counts = own, np.zeros(CHUNK, np.uint8)
                found = np.frombuffer(marks.as_buffer(), np.uint32)
                places = found >> 2
                counts[places] = np.minimum(counts[places] + (found & 3), 2)
        if chunk is not None:
            yield told()

    spread = hashes.select("h").mapInArrow(partial, "chunk long, marks binary").repartition("chunk").sortWithinPartitions("chunk")
    return spread.mapInArrow(merged, "block long, bits array<long>")


def possible_repeats(rows: DataFrame, counters: int) -> DataFrame:
    """Those of `rows` (with a hash `h`) whose counters all reached two: all that have an equal, and few others."""
    bits = F.broadcast(sketch(rows, counters))  # `counters` bits at most
    met = rows.withColumn("block", _block(F.col("h"), counters)).join(bits, "block")
    for k in range(PROBES):
        place = _places(F.col("h"), k)
        met = met.where(F.getbit(F.element_at("bits", (F.shiftright(place, 6) + 1).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return met.drop("block", "bits")


def _steps() -> list[tuple]:
    """(filter_order, step, bits of the filters before, bit of the step's filter) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[k] for k in order), step + 1, before, 1 << f))
            before |= 1 << f
    return out


def interactions(masks: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each, from the counts of each mask: (part, mask, n, good, toxic)."""
    steps = _steps()
    cases = F.array(*(F.struct(F.lit(p).alias("before"), F.lit(f).alias("own")) for p, f in sorted({(p, f) for _, _, p, f in steps})))
    mask, before, own = F.col("mask"), F.col("case.before"), F.col("case.own")
    fails, seen = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0

    def count(when: Column, n: str = "n") -> Column:
        return F.sum(F.when(when, F.col(n)).otherwise(0))

    # in 120 orders of five, each of the failing filters is the first to act as often
    turns = F.coalesce(F.try_divide(F.lit(120), F.bit_count(mask)), F.lit(0)).cast("long")
    counted = masks.withColumn("case", F.explode(cases)).groupBy("part", "case").agg(
        count(mask.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), count(fails & ~seen).alias("removed"), count(fails & seen).alias("redundant"), count(mask == own).alias("unique_fails"),
        count(fails & ~seen, "good").alias("good_lost"), count(fails & ~seen, "toxic").alias("toxic_lost"), F.sum(F.when(fails, F.col("n") * turns).otherwise(0)).alias("shapley"),
    )
    table = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    told = table.select("filter_order", "step", F.struct("before", "own").alias("case"))
    return counted.join(F.broadcast(told), "case").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), failing(text).cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = shared_table(rows.withColumn("h", F.xxhash64("digest")))
    with_id = rows.where("doc_id is not null")
    repeats = shared_checkpoint(possible_repeats(with_id, _counters(with_id.count())).drop("h"))
    firsts = repeats.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    later = repeats.join(firsts, ["doc_id", "digest"], "left_anti")
    told = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("good"), labels["toxic"].alias("toxic")).where("doc_id is not null")
    told = told.groupBy("doc_id").agg(*(F.max((F.col(k) == 1).cast("int")).alias(k) for k in ("good", "toxic")))

    def counts(of: DataFrame, mask: Column, sign: int) -> DataFrame:
        own = of.select("doc_id", "part", mask.alias("mask"))
        every = own.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", (sign * F.col("n")).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
        marked = own.join(told, "doc_id").groupBy("part", "mask").agg(*(F.sum(F.coalesce(k, F.lit(0)) * sign).alias(k) for k in ("good", "toxic")))
        return every.unionByName(marked.select("part", "mask", F.lit(0).alias("n"), "good", "toxic"))

    moved = counts(later, F.col("mask"), -1).unionByName(counts(later, F.col("mask").bitwiseOR(F.lit(16)), 1))
    masks = counts(rows, F.col("mask"), 1).unionByName(moved)
    return interactions(masks.groupBy("part", "mask").agg(*(F.sum(k).alias(k) for k in ("n", "good", "toxic"))))
