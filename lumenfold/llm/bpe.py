"""Byte-level BPE encoding and decoding by merge replay.

Texts are split by the tokenizer's pattern. The distinct words of a chunk of texts are laid out in one array of
tokens, and an inverted index holds, for the rank of each pair of neighbours, the places where that pair stands.
The merges are replayed in rank order over the whole chunk at once: each takes its places from the index, joins
the pairs from left to right and posts only the new pairs of the touched neighbours. As words never touch each
other, a chunk gives the same ids as a replay over the whole corpus would, and memory stays bounded by the chunk.
Ids of the texts are then put together from those of their words.

Nulls and edge cases: a null or empty text has no ids and decodes to no bytes; texts are taken whole; repeated
rows are encoded each on its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lumenfold.llm._text import slices

#: Distinct words that a task remembers; beyond that it starts anew, which costs time and changes nothing else.
REMEMBERED = 300_000
CHUNK_BYTES = 2 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Rank of each token, and the tokens by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


#: Over the number of tokens, so that left * STRIDE + right stands for a pair.
STRIDE = 1 << 20


@lru_cache(maxsize=2)
def merges(path: str) -> dict[int, int]:
    """The rank of every pair of tokens that joins into a token."""
    ranks, _ = vocabulary(path)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left * STRIDE + right] = rank
    return pairs


class MergeReplay:
    """Encodes many words at once."""

    def __init__(self, path: str):
        self.ranks, self.tokens = vocabulary(path)
        self.pairs = merges(path)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def _index(self, ids: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """The places of each rank among the pairs of neighbours that stand in one word."""
        keys, inverse = np.unique(ids[:-1] * STRIDE + ids[1:], return_inverse=True)
        ranks = np.array([self.pairs.get(key, -1) for key in keys.tolist()], np.int64)[inverse] if len(keys) else keys
        ranks[ends[(ends > 0) & (ends < len(ids))] - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, firsts = np.unique(ranks[order], return_index=True)
        return dict(zip(found.tolist(), (x.tolist() for x in np.split(order, firsts[1:])))) if len(found) else {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        ends = np.cumsum([0, *map(len, words)])
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        index, pair_rank = self._index(flat, ends), self.pairs.get
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        filled = np.flatnonzero(np.diff(ends))
        before[ends[filled]], after[ends[filled + 1] - 1] = -1, -1
        ids, after, before = flat.tolist(), after.tolist(), before.tolist()
        due = list(index)
        heapq.heapify(due)
        while due:
            rank = heapq.heappop(due)
            places = index.pop(rank)
            places.sort()
            for at in places:
                follower = after[at]
                if follower < 0 or ids[at] < 0 or pair_rank(ids[at] * STRIDE + ids[follower]) != rank:
                    continue
                ids[at], ids[follower] = rank, -1
                after[at] = beyond = after[follower]
                if beyond >= 0:
                    before[beyond] = at
                    if (new := pair_rank(rank * STRIDE + ids[beyond])) is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(due, new)
                left = before[at]
                if left >= 0 and (new := pair_rank(ids[left] * STRIDE + rank)) is not None:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heapq.heappush(due, new)
        flat = np.array(ids, np.int64)
        kept = np.concatenate(([0], np.cumsum(flat >= 0)))
        data, ends = flat[flat >= 0].astype("<u4").tobytes(), (4 * kept[ends]).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Splits texts and encodes them, remembering the words of earlier chunks."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split, self.replay, self.known = regex.compile(pattern).findall, MergeReplay(path), {}

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        found = [self.split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(dict.fromkeys(word for words in found for word in set(words) if word not in self.known))
        self.known.update(zip(new, self.replay.encode([word.encode() for word in new])))
        return [b"".join(map(self.known.__getitem__, words)) for words in found]


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _local(path: str) -> str:
    return path if path.startswith("/") else SparkFiles.get(path)


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(_local(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `ids` (binary: little-endian unsigned 32-bit integers) of each document.

    `path` is a rank file that every executor has at that place, or the name of one given to `SparkContext.addFile`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                ids = encoder.encode(text or "" for text in part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and `decoded` (binary, the bytes that the ids stand for). A null `ids` decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(_local(path))[1]
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = [x or b"" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array((decoded(x, tokens) for x in ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
