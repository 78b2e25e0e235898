"""Bursts and look-alikes, by joins on pieces of the perceptual hash and on time.

Two hashes that differ in up to 5 bits have two of 7 pieces in common, so pairs are found by equal pairs of pieces (18 bits or
more) and then tested exactly. Photos within 3 s are found by buckets of that length, some to a slot.

For groups (`burst_members`) the nodes are the distinct hashes of a library: its copies are of one group anyway, whenever they were
taken, so a hash counts once in each time bucket, with its first and last time there. Hashes of a library meet each other, and by
pieces only if it has more than `CROWD`. Where few hashes share a key they are joined; where
many do, blocks of them are compared in tasks, which return a star for each component of what they found, not the pairs. So
the links are linear in the hashes, whatever the photos of one moment have in common. `dup_edges` and `burst_edges` list pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import cover_score, hash_bits
from lumenfold.operators.components import components, least_reached
from lumenfold.options import BurstOptions

#: Hashes of one key that are joined with each other; of more, blocks are compared in tasks; and of more than `CROWD` in one moment, by pieces.
LIGHT, BLOCK, CROWD = 32, 2048, 8192
#: Time buckets of a slot, whose hashes meet: the fewer, the more hashes count to two.
SLOT_BUCKETS = 4
#: Groups of no more hashes are looked at together with others of their batch.
FEW = 256
#: Photos of a group are put in order within slices of an hour, and then slices.
SLICE_MS = 3_600_000


def _bands(bits: Column, pieces: int) -> Column:
    """(pair, value) of each pair of `pieces` cuts of 64 bits."""
    cuts = [round(64 * k / pieces) for k in range(pieces + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    pairs = [x | y for x, y in combinations(masks, 2)]
    return F.array(*(F.struct(F.lit(k).alias("pair"), bits.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for k, m in enumerate(pairs)))


def _guarded(photos: DataFrame, options: BurstOptions) -> DataFrame:
    own = photos.where(F.col("luma_variance") >= options.min_luma_variance).select("library_id", "id", "taken_at", hash_bits(F.col("phash")).alias("bits"))
    return own.where(F.col("bits").isNotNull())


def dup_edges(photos: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """(library_id, a, b): links that join all photos whose hashes differ in `dup_hamming` bits or less, directly or by copies.

    The smallest id of each hash stands for all that have it.
    """
    rows = _guarded(photos, options)
    hashes = rows.groupBy("library_id", "bits").agg(F.min("id").alias("rep"))
    stars = rows.join(hashes, ["library_id", "bits"]).where("id <> rep").select("library_id", F.col("rep").alias("a"), F.col("id").alias("b"))
    cut = hashes.withColumn("band", F.explode(_bands(F.col("bits"), options.dup_hamming + 2))).select("library_id", "bits", "rep", "band.pair", "band.value")
    left, right = cut, cut.select("library_id", "pair", "value", F.col("bits").alias("bits2"), F.col("rep").alias("rep2"))
    # the sizes that the optimizer guesses don't know of the explode: without a hint, 21 rows for each hash can be sent to the driver
    near = left.join(right.hint("merge"), ["library_id", "pair", "value"]).where((F.col("rep") < F.col("rep2")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= options.dup_hamming))
    return stars.unionByName(near.select("library_id", F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct())


def burst_edges(photos: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """(library_id, a, b), a before b in time (then id): photos at most `burst_ms` apart whose hashes differ in `burst_hamming` bits or less."""
    rows = _guarded(photos, options).where(F.col("taken_at").isNotNull()).withColumn("bucket", F.floor(F.col("taken_at") / options.burst_ms))
    later = rows.select("library_id", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), F.col("id").alias("id2"), F.col("taken_at").alias("taken2"), F.col("bits").alias("bits2"))
    gap = F.col("taken2") - F.col("taken_at")
    ordered = (gap > 0) | (gap == 0) & (F.col("id") < F.col("id2"))
    near = rows.join(later, ["library_id", "bucket"]).where(ordered & (gap <= options.burst_ms) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= options.burst_hamming))
    return near.select("library_id", F.col("id").alias("a"), F.col("id2").alias("b"))


def _forests(most_bits: int, most_ms: int):
    """Of each group of rows: a star for each component of its links (of those across the two blocks, if there are two)."""

    def stars(bits: np.ndarray, lib: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bits)
        links = np.zeros((n, n), bool)
        cut = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        rows, columns = (slice(0, cut), slice(cut, n)) if cut else (slice(0, n), slice(0, n))
        for start in range(rows.start, rows.stop, 256):
            own = slice(start, min(start + 256, rows.stop))
            near = np.bitwise_count(bits[own, None] ^ bits[None, columns]) <= most_bits
            gap = np.maximum(first[own, None], first[None, columns]) - np.minimum(last[own, None], last[None, columns])
            links[own, columns] = near & (lib[own, None] == lib[None, columns]) & ((bucket[own, None] == bucket[None, columns]) | (gap <= most_ms))
        if cut:
            links |= links.T
        left = links.any(axis=1)
        heads, ends = [], []
        while left.any():
            head = int(left.argmax())
            reached, due = np.zeros(n, bool), np.array([head])
            reached[head] = True
            while len(due):
                fresh = links[due].any(axis=0) & ~reached
                reached |= fresh
                due = np.flatnonzero(fresh)
            left &= ~reached
            found = np.flatnonzero(reached)
            heads.append(np.full(len(found) - 1, head))
            ends.append(found[found != head])
        return (np.concatenate(heads), np.concatenate(ends)) if heads else (np.zeros(0, int), np.zeros(0, int))

    def few(bits: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray, lib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of a small group."""
        a, b = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most_bits)
        a, b = a[a < b], b[a < b]
        gap = np.maximum(first[a], first[b]) - np.minimum(last[a], last[b])
        own = (lib[a] == lib[b]) & ((bucket[a] == bucket[b]) | (gap <= most_ms))
        return a[own], b[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def told(rows: pa.Table, cuts: np.ndarray) -> pa.Table:
            """The stars of the groups that start and end at `cuts`."""
            bits, lib, bucket, first, last, block = (rows.column(c).to_numpy() for c in ("bits", "lib", "bucket", "first", "last", "block"))
            bits = bits.view(np.uint64)
            heads, ends, loose = [np.zeros(0, int)], [np.zeros(0, int)], []
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = slice(start, stop)
                if stop - start > FEW:
                    a, b = stars(bits[own], lib[own], bucket[own], first[own], last[own], block[own])
                    heads.append(a + start)
                    ends.append(b + start)
                elif stop - start > 1:
                    a, b = few(bits[own], bucket[own], first[own], last[own], lib[own])
                    if len(a):
                        loose.append((a + start, b + start))
            if loose:
                label = least_reached(*map(np.concatenate, zip(*loose)), rows.num_rows)
                found = np.flatnonzero(label != np.arange(len(label)))
                heads.append(label[found])
                ends.append(found)
            a, b = np.concatenate(heads), np.concatenate(ends)
            return pa.table({"library_id": rows.column("library_id").take(a), "a": rows.column("rep").take(a), "b": rows.column("rep").take(b)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = rows.column("g").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            if len(cuts) > 1:
                yield from told(rows, cuts).to_batches()
            rest = rows.slice(int(cuts[-1]))
        if rest is not None:
            yield from told(rest, np.array([0, rest.num_rows])).to_batches()

    return run


def _links(rows: DataFrame, keys: tuple[str, ...], most_bits: int, most_ms: int) -> DataFrame:
    """(library_id, a, b): links that join all hashes of a library that share `keys` and are alike, directly or by others.

    `rows` are (library_id, keys, rep, bits, bucket, first, last): times in buckets of `most_ms`. At most `LIGHT` links for each row and
    key where few share it, and a forest of each pair of blocks where many do.
    """
    sizes = rows.groupBy("library_id", *keys).agg(F.count("*").alias("n")).where("n > 1")
    sizes = shared_checkpoint(sizes)
    light = rows.join(sizes.where(F.col("n") <= LIGHT).drop("n"), ["library_id", *keys])
    other = light.select("library_id", *keys, *(F.col(c).alias(f"{c}2") for c in ("rep", "bits", "bucket", "first", "last")))
    close = (F.col("bucket") == F.col("bucket2")) | (F.greatest("first", "first2") - F.least("last", "last2") <= most_ms)
    met = light.join(other, ["library_id", *keys]).where((F.col("rep") < F.col("rep2")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= most_bits) & close)
    out = met.select("library_id", F.col("rep").alias("a"), F.col("rep2").alias("b"))
    crowded = sizes.where(F.col("n") > LIGHT)
    if crowded.isEmpty():
        return out
    heavy = rows.join(crowded, ["library_id", *keys])
    if "pair" not in keys:  # a moment with very many hashes
        packed = heavy.where(F.col("n") > CROWD).drop("n")
        heavy = heavy.where(F.col("n") <= CROWD)
        if not crowded.where(F.col("n") > CROWD).isEmpty():
            bands = packed.withColumn("band", F.explode(_bands(F.col("bits"), most_bits + 2))).select(*packed.columns, "band.pair", "band.value")
            out = out.unionByName(_links(bands, (*keys, "pair", "value"), most_bits, most_ms))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = heavy.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("bits", F.lit(5)), blocks).cast("int")})
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = cut.select(F.xxhash64("library_id", *keys, "i", "j").alias("g"), F.xxhash64("library_id").alias("lib"), "library_id", "rep", "bits", "bucket", "first", "last", "block")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "block")  # few bytes, which take long
    kinds = dict(rows.dtypes)
    return out.unionByName(dealt.mapInArrow(_forests(most_bits, most_ms), f"library_id {kinds['library_id']}, a {kinds['rep']}, b {kinds['rep']}"))


def burst_links(photos: DataFrame, options: BurstOptions = BurstOptions()) -> tuple[DataFrame, DataFrame]:
    """(hashes, links): the distinct hashes of each library (library_id, bits, rep: the smallest id, n) and links (library_id, a, b) between their reps."""
    rows = _guarded(photos, options)
    hashes = shared_checkpoint(rows.groupBy("library_id", "bits").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    none = {k: F.lit(0).cast("long") for k in ("bucket", "first", "last")}
    alone = hashes.select("library_id", "rep", "bits").withColumns(none)
    rows = rows.withColumn("taken_at", F.col("taken_at").cast("long"))
    bucket = F.floor(F.col("taken_at") / options.burst_ms)
    held = rows.where(F.col("taken_at").isNotNull()).groupBy("library_id", "bits", bucket.alias("bucket")).agg(F.min("taken_at").alias("first"), F.max("taken_at").alias("last"))
    timed = held.join(hashes.select("library_id", "bits", "rep"), ["library_id", "bits"])
    slot = F.floor(F.col("bucket") / SLOT_BUCKETS)
    # the first bucket of a slot also counts to the slot before, whose last one it may be near to
    timed = shared_checkpoint(timed.withColumn("slot", F.explode(F.when(F.pmod("bucket", F.lit(SLOT_BUCKETS)) == 0, F.array(slot, slot - 1)).otherwise(F.array(slot)))))
    alike = _links(alone, (), options.dup_hamming, options.burst_ms)  # by pieces only in libraries of more than `CROWD`: 21 rows for each hash
    return hashes, alike.unionByName(_links(timed, ("slot",), options.burst_hamming, options.burst_ms))


def burst_hashes(photos: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """(library_id, bits, burst): the hashes of photos in groups of two or more; `burst` is the group's smallest id."""
    hashes, links = burst_links(photos, options)
    found = components(links.select(F.struct("library_id", F.col("a").alias("id")).alias("a"), F.struct("library_id", F.col("b").alias("id")).alias("b")), "library_id")
    named = found.select(F.col("node.library_id").alias("library_id"), F.col("node.id").alias("rep"), F.col("component.id").alias("named"))
    return hashes.join(named, ["library_id", "rep"], "left").where("n > 1 or named is not null").select("library_id", "bits", F.coalesce("named", "rep").alias("burst"))


def burst_members(photos: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """(library_id, id, burst): photos in groups of two or more; `burst` is the group's smallest id."""
    return _guarded(photos, options).join(burst_hashes(photos, options), ["library_id", "bits"]).select("library_id", "id", "burst")


def with_bursts(photos: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """`photos` with their `burst`, null outside of groups: as a join with `burst_members`, but by hash, so that photos move once."""
    bits = F.when(F.col("luma_variance") >= options.min_luma_variance, hash_bits(F.col("phash")))
    return photos.withColumn("bits", bits).join(burst_hashes(photos, options), ["library_id", "bits"], "left").drop("bits")


def with_counted(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """`photos` (of `with_bursts`) with `counted`: whether a photo is the cover of its group, or in none. Only photos of groups move."""
    grouped = photos.where("burst is not null").join(groups.select("library_id", "burst", "cover_id"), ["library_id", "burst"])
    return photos.where("burst is null").withColumn("counted", F.lit(True)).unionByName(grouped.withColumn("counted", F.col("id") == F.col("cover_id")).drop("cover_id"))


def burst_groups(photos: DataFrame, members: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """One row for each group: n, cover_id, start, end, and subtype `burst` (all timed, close in time, three or more) or `dup`.

    A group of any size is spread: photos of one moment are one row; these are put in order within each slice of time, which keeps its
    first and last moment and its largest gap; and slices are put in order, where the gaps between them count too.
    """
    return groups_of(photos.join(members, ["library_id", "id"]), options)


def groups_of(in_groups: DataFrame, options: BurstOptions = BurstOptions()) -> DataFrame:
    """`burst_groups` of photos with a `burst`."""
    best = F.struct(-cover_score(F.col("edge_density"), F.col("brightness"), F.col("colorfulness")), F.col("id"))
    moments = in_groups.groupBy("library_id", "burst", F.floor(F.col("taken_at") / SLICE_MS).alias("slice"), "taken_at").agg(F.count("*").alias("n"), F.min(best).alias("best"))
    gap = F.col("taken_at") - F.lag("taken_at").over(Window.partitionBy("library_id", "burst", "slice").orderBy("taken_at"))
    slices = moments.withColumn("gap", gap).groupBy("library_id", "burst", "slice").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("taken_at").isNotNull(), F.col("n")).otherwise(0)).alias("timed"), F.min("best").alias("best"), F.min("taken_at").alias("first"), F.max("taken_at").alias("last"), F.max("gap").alias("gap")
    )
    before = F.lag("last").over(Window.partitionBy("library_id", "burst").orderBy(F.asc_nulls_last("slice")))
    grouped = slices.withColumn("gap", F.greatest("gap", F.col("first") - before)).groupBy("library_id", "burst").agg(
        F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.max("gap").alias("gap"), F.min("first").alias("start"), F.max("last").alias("end"), F.min("best").alias("best")
    )
    close = (F.col("timed") == F.col("n")) & (F.col("n") >= options.min_burst_size) & (F.coalesce("gap", F.lit(0)) <= options.burst_ms)
    return grouped.select("library_id", "burst", "n", F.col("best.id").alias("cover_id"), "start", "end", F.when(close, "burst").otherwise("dup").alias("subtype"))
