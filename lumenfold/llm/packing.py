"""Best-fit packing of documents into training rows, under conflicts.

No two pieces of one bin come from the same source or from the same cluster of duplicates. Documents longer than
a bin are cut into pieces of its capacity. Pieces are dealt by a hash of document and piece into blocks of about
`block` pieces, whatever their source, and each block is packed on its own: largest first, each into the tightest
bin that it fits in. Open bins stand in order of what is left in them; the search begins at the first that is large
enough and goes on to its successors until the bin's bitmaps of sources and clusters have none of the piece's bits.
If no bin is compatible, a new one is opened.

Nulls and edge cases: a null source or cluster conflicts with nothing; a null or wordless text is one piece of no
words; repeated rows are packed each (they share their cluster, so in different bins); ties go to the smaller
document, then piece; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint

CAPACITY, BLOCK = 2048, 4096
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_words long"


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """The bin of each item, taken in the given order; `masks` has a bit for each thing that must be alone in a bin."""
    spare: list[tuple[int, int]] = []
    held: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        at = bisect_left(spare, (size, -1))
        while at < len(spare) and held[spare[at][1]] & mask:
            at += 1
        if at < len(spare):
            left, chosen = spare.pop(at)
            held[chosen] |= mask
        else:
            left, chosen = capacity, len(held)
            held.append(mask)
        insort(spare, (left - size, chosen))
        out.append(chosen)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs twice or more; 0 for nulls and the rest."""
    again = values[values.duplicated(keep=False) & values.notna()].unique()
    bit = {v: 1 << k for k, v in enumerate(again)}
    return [bit.get(v, 0) if pd.notna(v) else 0 for v in values]


def _pack(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sources, clusters = _bits(pieces["source"]), _bits(pieces["cluster"])
        shift = max((x.bit_length() for x in sources), default=0)
        bins = pd.Series(best_fit(pieces["n_words"].tolist(), [a | b << shift for a, b in zip(sources, clusters)], capacity))
        pieces["bin_words"] = pieces["n_words"].groupby(bins).transform("sum")
        pieces["bin_id"] = pieces["block"].astype("int64") * 2**32 + bins
        return pieces[[x.split()[0] for x in SCHEMA.split(", ")]]

    return run


def pack(docs: DataFrame, n_words: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """A row for each piece: document, piece, its first word and number of words, its bin and the words in that bin.

    One shuffle, of a few numbers and the source for each document; the texts stay where they are.
    """
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(n_words, F.lit(0)).cast("long").alias("words"), source.cast("string").alias("source"), cluster.alias("cluster"))
    sized = shared_checkpoint(sized)  # a few numbers for each document; the texts are read once
    parts = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity))
    blocks = max(1, (sized.agg(F.sum(parts)).first()[0] or 0) // block)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("words") / capacity).cast("int") - 1))))
    pieces = pieces.select("doc_id", "piece", "source", "cluster", (F.col("piece").cast("long") * capacity).alias("start_word"), F.least(F.lit(capacity), F.col("words") - F.col("piece").cast("long") * capacity).alias("n_words"))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    return pieces.groupBy("block").applyInPandas(_pack(capacity), SCHEMA)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """`pack` with the words `[^\\x20\\x09-\\x0D]+` of the texts as sizes, and equal texts as clusters; without a column of sources only clusters conflict."""
    text, source = docs[text_col], docs[source_col] if source_col in docs.columns else F.lit(None)
    return pack(docs, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), source, F.md5(text), id_col, capacity)
