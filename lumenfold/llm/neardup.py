"""Near-duplicate groups by an inverted join on MinHash coordinates.

1. Each text becomes the set of its 5-word shingles (64-bit hashes) and a signature of `coordinates` minima.
   Texts with equal sets are one class, represented by its smallest id.
2. Every class is posted under each (coordinate, value) pair. Pairs that only one class has can match nothing and
   are skipped; a class with fewer than `matches` others left can reach the threshold with nobody and is skipped.
3. Prefix: two signatures that agree in `matches` of m coordinates agree in one of any m - matches + 1 of each when
   both take them in the same order. Classes are posted only under their rarest ones, so that passages that many
   texts share fall out of the prefixes.
4. In each posting list the collisions of two classes are counted over their whole signatures; pairs with
   `matches` or more count in the first list that they share. Long lists are cut into blocks, and each pair of
   blocks is a task of its own. Only the classes of such pairs are kept, not the pairs.
   A list longer than a block first meets its leaders, `LEADERS` of its classes that a hash of the class gives, so that the lists of one
   family mostly have the same. Classes that exact links join to a leader are of its component whatever else they are linked with.
   Those of the leader with the most need not meet each other any more in this list: only what is left meets all of it. A
   family of n near copies costs some n rows for each leader and list, instead of n^2 / `block`.
5. The full shingle sets of those classes meet in their blocks, where intersections are counted exactly, and links
   with 100 * intersection >= `percent` * union are kept, as a spanning forest of each block (no component changes).
6. Components of the links name the groups.

With 64 coordinates and a threshold of 40, a pair at similarity 0.85 passes step 4 with a probability over 0.99999,
and a more similar one still more surely; what passes is confirmed exactly. At lower percentages pass fewer `matches`:
at similarity 0.80, 40 miss 3.5e-4 of the pairs and 36 miss 4.2e-6.

Nulls and edge cases: a null or wordless text has an empty set and links with nothing; a text of fewer than five
words is one shingle; long texts are taken whole; rows with the same id count as one document, of which the text with the
smallest MD5 counts; rows with a null id are documents of their own that link with nothing, keep a null component and are
kept; at equal sets the smallest id stands for its class, and the smallest id of a group is its component; an empty table
gives an empty result; only the id and text columns are read, so other columns, also ones named like results, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.llm._text import as_texts, slices, words
from lumenfold.operators.components import components

COORDINATES, MATCHES, PERCENT, WIDTH = 64, 40, 85, 5
#: Classes in a block of a posting list, and leaders of longer lists.
BLOCK, LEADERS = 512, 1
#: Ids of texts that are broadcast at most.
SENT = 300_000
_ODD = np.random.default_rng(7).integers(0, 2**63, 2 * 128, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased first."""
    codes, ends, vocabulary = words(pc.ascii_lower(as_texts(column)))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()], np.uint64)[codes]
    out = []
    joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        joined = _mixed(joined + hashes[k : len(hashes) - width + 1 + k] + np.uint64(k + 1)) if len(joined) else joined
    for start, stop in zip(ends, ends[1:]):
        if stop - start >= width:
            out.append(np.unique(joined[start : stop - width + 1]))
        elif stop > start:
            short = np.full(1, 99, np.uint64)
            for k in range(start, stop):
                short = _mixed(short + hashes[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of `coordinates` 32-bit minima for each non-empty set."""
    out = np.empty((len(sets), coordinates), np.uint32)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(sets):  # about 32,000 hashes at a time stay in the processor's cache
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + 32_768, side="right")) - 1)
        flat, begins = np.concatenate(sets[start:stop]), ends[start:stop] - ends[start]
        for k in range(coordinates):
            out[start:stop, k] = np.minimum.reduceat((flat * _ODD[2 * k] + _ODD[2 * k + 1]) >> np.uint64(32), begins)
        start = stop
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("own"))


def _signed(docs: DataFrame, coordinates: int) -> DataFrame:
    """doc_id, own, n_shingles, the digest of the set and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(part.column("text"))
                full = [k for k, s in enumerate(sets) if len(s)]
                rows = dict(zip(full, signatures([sets[k] for k in full], coordinates)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("own"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([rows[k].tobytes() if k in rows else None for k in range(len(sets))], pa.binary()),
                    ],
                    names=["doc_id", "own", "n_shingles", "digest", "signature"],
                )

    return docs.mapInArrow(run, "doc_id long, own string, n_shingles long, digest binary, signature binary")


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) of `reps` (rep, own): whole sets, from the texts that the signatures are of.

    Up to `SENT` ids and digests are sent to all tasks (some 80 bytes each), so that no other text moves; more are joined.
    """
    keys = shared_checkpoint(reps.select(F.col("rep").alias("doc_id"), "own"))
    keys = F.broadcast(keys) if keys.count() <= SENT else keys
    wanted = docs.join(keys, ["doc_id", "own"], "left_semi").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingles(part.column("text"))], pa.binary())], names=["rep", "shingles"])

    return wanted.mapInArrow(run, "rep long, shingles binary")


def _posted(classes: DataFrame, coordinates: int) -> DataFrame:
    """(h, rep): a row for each coordinate of each class; h holds the coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
                yield pa.RecordBatch.from_arrays([pa.array((values + places).ravel()), pa.array(np.repeat(part.column("rep").to_numpy(zero_copy_only=False), coordinates))], names=["h", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "h long, rep long")


def _forest(n: int, links: np.ndarray) -> np.ndarray:
    """Those of `links` (pairs of indices) that join two trees of the forest that the earlier ones make."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in links.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (h, i, j) in tables of whole groups, and where each group begins and the last one ends."""
    rest: pa.Table | None = None

    def cut(rows: pa.Table) -> np.ndarray:
        keys = np.stack([rows.column(k).to_numpy() for k in ("h", "i", "j")])
        return np.append(np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), rows.num_rows)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if rows.num_rows:
            ends = cut(rows)
            rest = rows.slice(int(ends[-2]))
            if len(ends) > 2:
                yield rows.slice(0, int(ends[-2])).combine_chunks(), ends[:-1]
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), cut(rest)


def _pairs(ends: np.ndarray, first: np.ndarray, alone: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows to compare, about `most` at a time: all of a group whose blocks are one (`alone`), else those across its
    two blocks, of which the rows in the first (`first`) come first."""
    n, size = int(ends[-1]), np.diff(ends)
    end = np.repeat(ends[1:], size)
    second = np.repeat(ends[:-1] + np.add.reduceat(first, ends[:-1]), size)
    begin = np.where(alone, np.arange(n) + 1, np.where(first, second, end))
    total = np.concatenate(([0], np.cumsum(end - begin)))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        count = (end - begin)[start:stop]
        a = np.repeat(np.arange(start, stop), count)
        if len(a):
            yield a, begin[a] + np.arange(len(a)) - np.repeat(total[start:stop] - total[start], count)
        start = stop


def _colliding(matches: int, coordinates: int):
    """The classes with `matches` collisions with another one of their group that no earlier list has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(coordinates)
        for rows, ends in _groups(batches):
            values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
            posted = (rows.column("mask").to_numpy()[:, None] >> places) & 1 > 0
            own = rows.column("h").to_numpy() >> 32
            i, j, block = (rows.column(k).to_numpy() for k in ("i", "j", "block"))
            found = np.zeros(rows.num_rows, bool)
            for a, b in _pairs(ends, block == i, i == j, 50_000):
                same = values[a] == values[b]
                a, b, same = (x[same.sum(axis=1) >= matches] for x in (a, b, same))
                first = ~(same & posted[a] & posted[b] & (places < own[a, None])).any(axis=1)
                found[a[first]] = found[b[first]] = True
            yield from rows.select(["h", "i", "j", "rep", "block"]).filter(pa.array(found)).to_batches()

    return run


def _linked(percent: int):
    """A spanning forest of the exact links of each group, from full sets."""

    def few(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs.tolist()])
        total = np.array([len(sets[a]) + len(sets[b]) for a, b in pairs.tolist()])
        return pairs[100 * common >= percent * (total - common)]

    def many(sets: list[np.ndarray]) -> np.ndarray:
        """All links, by products of the incidence matrix of the shingles that two sets or more have."""
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.append(True, flat[1:] != flat[:-1])) - 1
        shared = np.bincount(column)[column] > 1
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[owner[a:b], column[a:b] - low] = 1
            both += held @ held.T
        return np.argwhere(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _groups(batches):
            reps, shingle, i, j, block = (rows.column(k) for k in ("rep", "shingles", "i", "j", "block"))
            reps, i, j, block = (x.to_numpy() for x in (reps, i, j, block))
            kept = []
            for start, stop in zip(ends, ends[1:]):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingle.slice(start, stop - start)]
                pairs = np.argwhere(np.triu(np.ones((len(sets), len(sets)), bool), 1)) if len(sets) <= 8 else None
                links = few(sets, pairs) if pairs is not None else many(sets)
                if i[start] != j[start]:
                    links = links[block[start + links[:, 0]] != block[start + links[:, 1]]]
                kept.append(start + _forest(len(sets), links))
            links = np.concatenate(kept)
            yield pa.RecordBatch.from_arrays([pa.array(reps[links[:, 0]]), pa.array(reps[links[:, 1]])], names=["a", "b"])

    return run


def _alike(matches: int, coordinates: int):
    """Those rows (leader, rep, and both signatures) that agree in `matches` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                own, other = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, coordinates) for c in ("signature", "led_by"))
                near = (own == other).sum(axis=1) >= matches
                yield part.select(["leader", "rep"]).filter(pa.array(near))

    return run


def _led(percent: int):
    """(a, b): the leader of each group and those that exact links within the group join to it."""
    linked = _linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _groups(batches):
            for start, stop in zip(ends, ends[1:]):
                own = rows.slice(int(start), int(stop - start))
                edges = [pair for found in linked(iter(own.to_batches())) for pair in zip(found.column("a").to_pylist(), found.column("b").to_pylist())]
                leader, near = own.column("h")[0].as_py(), {}
                for a, b in edges:
                    near.setdefault(a, []).append(b)
                    near.setdefault(b, []).append(a)
                reached, due = {leader}, [leader]
                while due:
                    fresh = [x for x in near.get(due.pop(), ()) if x not in reached]
                    reached.update(fresh)
                    due += fresh
                found = sorted(reached - {leader})
                yield pa.RecordBatch.from_arrays([pa.array([leader] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return run


def _after_leaders(docs: DataFrame, classes: DataFrame, long: DataFrame, percent: int, coordinates: int, matches: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(links to leaders, rows to compare) of the long lists `long` (h, rep, mask): rows (h, i, j, block, rep, mask)."""
    turns = [F.min_by("rep", F.struct(F.xxhash64("rep", F.lit(k)), F.col("rep"))) for k in range(LEADERS)]
    heads = shared_checkpoint(long.groupBy("h").agg(F.array_distinct(F.array(*turns)).alias("leaders")))
    asks = long.select("h", "rep").join(heads, "h").select("rep", F.explode("leaders").alias("leader")).where("rep <> leader").distinct()
    signed = classes.select("rep", "signature")
    asks = asks.join(signed, "rep").join(signed.select(F.col("rep").alias("leader"), F.col("signature").alias("led_by")), "leader")
    near = shared_checkpoint(asks.select("leader", "rep", "signature", "led_by").mapInArrow(_alike(matches, coordinates), "leader long, rep long"))
    salts = near.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    members = near.join(salts, "leader").select(F.col("leader").alias("h"), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("i"), "rep", F.lit(1).alias("block"))
    first = salts.select(F.col("leader").alias("h"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("i"), F.col("leader").alias("rep"), F.lit(0).alias("block"))
    groups = members.unionByName(first).withColumn("j", F.col("i"))
    full = _sets(docs, classes.join(groups.select("rep").distinct(), "rep", "left_semi").select("rep", "own"))
    led = shared_checkpoint(_by_group(groups.select("h", "i", "j", "rep", "block").join(full, "rep")).mapInArrow(_led(percent), "a long, b long"))
    inside = shared_checkpoint(heads.select("h", F.explode("leaders").alias("leader")).join(led.withColumnRenamed("a", "leader"), "leader").join(long.select("h", F.col("rep").alias("b")), ["h", "b"]))
    # only those of one leader are known to be of one component: of that with the most
    most = inside.groupBy("h", "leader").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
    inside = inside.join(most, ["h", "leader"], "left_semi").select("h", F.col("b").alias("rep")).unionByName(most.select("h", F.col("leader").alias("rep")))
    rows = shared_checkpoint(long.join(inside.distinct().withColumn("in_reach", F.lit(True)), ["h", "rep"], "left").withColumn("in_reach", F.col("in_reach").isNotNull()))
    sizes = rows.groupBy("h").agg(F.ceil(F.count_if(~F.col("in_reach")) / block).cast("int").alias("rest"), F.ceil(F.count_if("in_reach") / block).cast("int").alias("done"))
    placed = rows.join(sizes, "h").withColumn("block", F.when(F.col("in_reach"), F.col("rest") + F.pmod(F.xxhash64("rep", "h"), F.greatest("done", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep", "h"), F.greatest("rest", F.lit(1)))).cast("int"))
    others = F.when(F.col("in_reach"), F.when(F.col("rest") > 0, F.sequence(F.lit(0), F.col("rest") - 1))).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("done") - 1))
    paired = placed.withColumn("other", F.explode(others)).select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "mask")
    return led, paired


def _by_group(rows: DataFrame) -> DataFrame:
    """Rows of a group (h, i, j) in one partition, side by side, its first block before its second."""
    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "block", "rep")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and kept (doc_id = component_id)."""
    docs = _rows(docs, id_col, text_col)
    every = shared_checkpoint(_signed(docs, coordinates))
    one = F.min_by(F.struct("own", "n_shingles", "digest", "signature"), "own")
    signed = every.where("doc_id is not null").groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("own", "signature"), "doc_id").alias("one"))
    classes = shared_checkpoint(classes.select("digest", "rep", "one.*"))

    posts = _posted(classes, coordinates)
    counts = posts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    frequent = posts.join(counts, "h")
    by_class = Window.partitionBy("rep").orderBy("n", "h")
    alone = F.lit(coordinates) - F.count("*").over(Window.partitionBy("rep"))
    prefix = frequent.withColumns({"k": F.row_number().over(by_class), "alone": alone})
    prefix = prefix.where((F.lit(coordinates) - F.col("alone") >= matches) & (F.col("k") + F.col("alone") <= coordinates - matches + 1))
    prefix = prefix.withColumn("mask", F.sum(F.expr("shiftleft(1L, cast(shiftright(h, 32) as int))")).over(Window.partitionBy("rep")))
    prefix = shared_checkpoint(prefix.select("h", "rep", "mask"))
    sizes = prefix.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sizes = shared_checkpoint(sizes)
    short = prefix.join(sizes.where("blocks = 1").select("h"), "h")
    paired = short.select("h", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "rep", "mask")
    led = None
    if not sizes.where("blocks > 1").isEmpty():
        long = prefix.join(sizes.where("blocks > 1").select("h"), "h")
        led, rest = _after_leaders(docs, classes, shared_checkpoint(long), percent, coordinates, matches, block)
        paired = paired.unionByName(rest)
    paired = paired.join(classes.select("rep", "signature"), "rep")
    meets = _by_group(paired).mapInArrow(_colliding(matches, coordinates), "h long, i int, j int, rep long, block int")
    meets = shared_checkpoint(meets)

    full = _sets(docs, classes.join(meets.select("rep").distinct(), "rep", "left_semi").select("rep", "own"))
    links = _by_group(meets.join(full, "rep")).mapInArrow(_linked(percent), "a long, b long")
    links = links if led is None else links.unionByName(led)
    named = components(links)
    reps = classes.select("digest", "rep").join(named.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = signed.join(reps, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    found = found.unionByName(every.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """One row of `docs`, with all its columns, for the smallest id of each group; all rows with a null id stay.

    Of rows with the same id the one whose text has the smallest MD5 stays, any one of equal texts.
    """
    found = near_duplicates(docs, id_col, text_col, percent, matches=matches)
    # rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("key"), F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("own"))
    left = rows.join(found.where("not kept").select(F.col("doc_id").alias("key")), "key", "left_anti")
    again = rows.where("key is not null").groupBy("key").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    if again.isEmpty():
        return left.select("row.*")
    many = left.join(again, "key", "left")
    first = many.where(F.col("own") == F.col("least")).dropDuplicates(["key"])
    return many.where("least is null").unionByName(first).select("row.*")
