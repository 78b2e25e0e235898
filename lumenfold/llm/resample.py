"""Importance resampling toward a target distribution, by hashed n-grams whose CRCs come of prefix CRCs.

1. Each text is normalised to words with one space before each, and scanned once: the running CRC-32 after each word is kept.
   CRCs are linear over GF(2): with A before B, crc(B) = crc(AB) xor shift(crc(A), bytes of B), where the shift is what as many
   zero bytes would do. So the CRC of any run of words follows from two running CRCs, without reading its bytes again; shifts
   are done for all runs of a slice at once, with a table for each power of two.
2. A feature's bucket is its CRC modulo `buckets`. The buckets of each text are written to the shared folder, so that texts are
   read once; their counts over all texts, and over all target texts, are two aggregations of `buckets` rows.
3. A bucket's gain is the floored thousandfold logarithm of how much likelier it is in the target, with one added to each
   count. A text's weight is the sum of its features' gains, and its score the weight and a Gumbel number from a hash of its
   id: the highest scores are a draw without replacement with chances as the weights say.
4. Ranks come of a sort by ranges: each partition numbers its own rows, and the sizes of the partitions before are added. No
   task sees all rows, and ties of any size are spread, as the order ends with a number of its own for each row.

Nulls and edge cases: a null text counts as empty: no features, weight 0; texts are taken whole; rows with a null id have
features and a weight and count in the corpus, but no score, and are never drawn; rows with the same id are drawn on
their own, with equal chances (in any order if all else is equal); a table without rows gives none; only the id and text
columns are read, so other columns, also ones named like results, play no part. `longest` is the number of words in the
longest feature; texts with fewer words have only the shorter ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_table
from lumenfold.llm._text import as_texts, raw, slices, sums

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: ASCII letters and digits and all bytes of other characters are parts of words; A-Z are lower-cased, all else is a separator.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def _applied(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map, given by a table for each byte of its argument."""
    return tables[0][crcs & 255] ^ tables[1][crcs >> 8 & 255] ^ tables[2][crcs >> 16 & 255] ^ tables[3][crcs >> 24]


def _shift_tables(most: int = 32) -> list[np.ndarray]:
    """Tables of what 1, 2, 4, ... zero bytes do to a CRC."""
    one = np.array([crc32(bytes([b])) for b in range(256)], np.uint32)
    one = one ^ one[0]  # without the inversions at both ends: what a byte in the register leaves
    low = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one, *(low << np.uint32(8 * (k - 1)) for k in (1, 2, 3))])]
    while len(tables) < most:
        tables.append(np.stack([_applied(tables[-1], t) for t in tables[-1]]))
    return tables


SHIFTS = _shift_tables()


def shifted(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as `sizes` says."""
    out = crcs.copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero(sizes >> k & 1)
        out[at] = _applied(SHIFTS[k], out[at])
    return out


def _after_space(crcs: np.ndarray) -> np.ndarray:
    """Running CRCs after one more space."""
    held = ~crcs
    return ~(SHIFTS[0][0][(held ^ 32) & 255] ^ held >> 8)


def scanned(text: bytes) -> tuple[list[int], list[int]]:
    """The running CRC after each word of the normalised text, and the words' sizes in bytes."""
    crc = 0
    words = text.translate(_NORMAL).split()
    return [crc := crc32(w, crc32(b" ", crc)) for w in words], list(map(len, words))


def feature_crcs(texts: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRCs of all runs of 1 to `longest` words, text by text; the texts' numbers of runs and of words)."""
    scans = [scanned(t) for t in texts]
    words = np.array([len(c) for c, _ in scans], np.int64)
    after = np.fromiter((c for crcs, _ in scans for c in crcs), np.uint32, int(words.sum()))
    size = np.fromiter((s for _, own in scans for s in own), np.int64, len(after))
    owner = np.repeat(np.arange(len(texts)), words)
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    before = _after_space(np.where(first, np.uint32(0), np.append(np.uint32(0), after[:-1]).astype(np.uint32)[: len(after)]))
    ends = np.cumsum(size + 1)
    found, owners = [], []
    for n in range(1, longest + 1):
        start = np.arange(max(0, len(after) - n + 1))
        start = start[owner[start] == owner[start + n - 1]]
        stop = start + n - 1
        found.append(after[stop] ^ shifted(before[start], ends[stop] - ends[start] + size[start]))
        owners.append(owner[start])
    crcs, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return crcs[order], np.bincount(owners, minlength=len(texts)), words


def featured(rows: DataFrame, text_col: str, id_col: str | None = None, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, ids) of each row; ids holds the buckets of its features as little-endian numbers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    doc_id = F.lit(None).cast("long") if id_col is None else rows[id_col].cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = raw(as_texts(part.column("text")))
                whole = data.tobytes()
                crcs, counts, words = feature_crcs([whole[a:b] for a, b in zip(at, at[1:])], longest)
                held, ends = (crcs % np.uint32(buckets)).astype(kind).tobytes(), np.append(0, np.cumsum(counts)) * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(counts), pa.array([held[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "n_words", "n_features", "ids"])

    return rows.select(doc_id.alias("doc_id"), rows[text_col].alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, ids binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket that occurs does. A task sends one row for each bucket at most."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                held += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=buckets)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["bucket", "n"])

    return features.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from its counts in the corpus and in the target."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + n) / ((source + 1.0) * (t + n)))).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                counts = part.column("n_features").to_numpy(zero_copy_only=False)
                total = sums(gain[np.frombuffer(b"".join(part.column("ids").to_pylist()), kind)], np.append(0, np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), part.column("n_features"), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The floored thousandfold Gumbel number of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """`rows` with `rank`, from 1 in the given order of all rows, and how many there are.

    Written once, as the bounds of ranges are sampled and would not be the same again. What reaches the driver is a count for each
    partition.
    """
    own = rows.withColumn("__own", F.monotonically_increasing_id())
    kept = shared_table(own.repartitionByRange(*order, F.col("__own")).sortWithinPartitions(*order, "__own").withColumn("__at", F.monotonically_increasing_id()).drop("__own"))
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for k, n in sizes:
        starts[k], total = total, total + n
    begins = F.lit([starts.get(k, 0) for k in range(max(starts, default=0) + 1)]).cast("array<long>")
    return kept.withColumn("rank", F.element_at(begins, (part + 1).cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at"), total


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the documents with `least_words` words or more, `percent` of a hundred are drawn: those with the highest scores, ties to the
    smaller id. Their rank counts from 1; it is null for all others.
    """
    features = shared_table(featured(docs, text_col, id_col, buckets, longest))
    counts = []
    for rows in (features, featured(target, target_col, None, buckets, longest)):
        held = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, buckets).collect():  # one row for each bucket at most
            held[r["bucket"]] = r["n"]
        counts.append(held)
    scored = weighted(features, gains(*counts)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    listed, n = ranked(scored.where(fit), F.desc("score"), F.asc("doc_id"))
    drawn = math.floor(percent * n / 100)
    names = ["doc_id", "n_features", "weight", "score"]
    return listed.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~fit).select(*names, F.lit(None).cast("long").alias("rank")))
