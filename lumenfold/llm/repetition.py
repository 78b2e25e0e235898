"""Quality rules on repetition, from the suffix array of each text's words.

The words of each text are suffix-sorted by prefix doubling (all texts of a slice at once; a suffix never
runs into the next text). Two neighbours of the suffix array share a prefix of `lcp` words; each maximal run of
neighbours with at least that many is an LCP interval, that is, a maximal repeated substring with all its places.
The deepest interval that a suffix lies in has the depth max(lcp before, lcp after), which is the longest
repeat that starts at its position. The union of these spans is the repeated part of the text.

Nulls and edge cases: a null or empty text has no words, fails the base rule and is not kept; texts of any length
are taken whole; repeated rows are judged each on its own; an empty table gives an empty result. Only the id and
text columns are read, so other columns, also ones named like results, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenfold.llm._text import as_texts, lists, raw, slices, sums, words

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_words", "longest_repeat")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_words long, longest_repeat long"


@dataclass(frozen=True)
class RepetitionRules:
    """A text is kept if it passes the base rule, its repeats of `long_repeat` words or more cover at most `max_covered`
    of its words, and none is longer than `max_longest` words, however long the text. No text of sf0.1 that passes the
    base rule repeats more than 13 words, so these limits leave clean texts alone. `min_repeat` is for `repeat_words`."""

    min_words: int = 50
    max_window_percent: int = 50
    min_repeat: int = 4
    long_repeat: int = 20
    max_covered: float = 0.2
    max_longest: int = 100


def longest_repeats(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there and also starts elsewhere in the same text."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    first, rank = _ranked(row * (int(codes.max()) + 1) + codes)
    last = ends[row + 1]
    levels, width, active = [], 1, np.flatnonzero(_shared(rank, n))
    levels.append(np.append(rank, -1))
    while len(active):
        own = rank[active]
        after = active + width
        following = np.where(after < last[active], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(own * (n + 2) + following, kind="stable")
        own, following, active = own[order], following[order], active[order]
        group = np.append(True, own[1:] != own[:-1])
        place = np.arange(len(active))
        fresh = group | np.append(True, following[1:] != following[:-1])
        rank = rank.copy()
        rank[active] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(np.append(rank, -1))
        width *= 2
        alone = fresh & np.append(fresh[1:], True)
        active = np.sort(active[~alone])
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    one, two = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][one] == levels[0][two])
    a, b = one[pairs].copy(), two[pairs].copy()
    common = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][a] == levels[level][b]
        step = same * (1 << level)
        a, b, common = np.minimum(a + step, n), np.minimum(b + step, n), common + step
    lcp = np.zeros(n + 1, np.int64)
    lcp[pairs + 1] = common
    out = np.empty(n, np.int64)
    out[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of `keys`, and for each key the place where its equals begin in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begins = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
    return order, rank


def _shared(rank: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rank, minlength=n)[rank] > 1


def covered(repeats: np.ndarray, least: int, ends: np.ndarray, width: int | None = None) -> np.ndarray:
    """Words of each row inside a repeat of at least `least` words, or inside its first `width` words."""
    at = np.flatnonzero(repeats >= least)
    edge = np.zeros(len(repeats) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (repeats[at] if width is None else width), -1)
    return sums(np.cumsum(edge[:-1]) > 0, ends)


def text_stats(column: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The numbers in STATS for each text of one Arrow array, and long_words: its words in repeats of `long_repeat` or more."""
    texts = as_texts(column)
    codes, ends, vocabulary = words(texts)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    data, bounds = raw(texts)
    lines, line_ends = lists(pc.split_pattern(texts, "\n"))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(len(texts)), np.diff(line_ends))[worded]
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[worded]
    distinct = np.unique(line_row * (len(lines) + 1) + line_codes) // (len(lines) + 1)
    repeats = longest_repeats(codes, ends)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), np.diff(ends)), repeats)
    return {
        "n_words": np.diff(ends),
        "word_chars": sums(lengths[codes], ends),
        "n_symbols": sums(SYMBOLS[data[bounds[0] : bounds[-1]]], bounds - bounds[0]),
        "n_dup_lines": np.bincount(line_row, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts)),
        "n_repeat_words": covered(repeats, 3, ends, 3),
        "repeat_words": covered(repeats, rules.min_repeat, ends),
        "longest_repeat": longest,
        "long_words": covered(repeats, rules.long_repeat, ends),
    }


def verdicts(stats: dict[str, np.ndarray], rules: RepetitionRules) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    n = stats["n_words"]
    failed = (n < rules.min_words) | (100 * stats["n_repeat_words"] > rules.max_window_percent * n)
    return failed, ~failed & (stats["longest_repeat"] <= rules.max_longest) & (stats["long_words"] <= rules.max_covered * n)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per document with its word counts, repeats and verdict. No shuffle: a map over Arrow batches."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats = text_stats(part.column("text"), rules)
                failed, kept = verdicts(stats, rules)
                columns = [*(stats[k] for k in STATS[:5]), failed, kept, *(stats[k] for k in STATS[5:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text passes the rules."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(verdicts(text_stats(part.column(text_col), rules), rules)[1]))

    return docs.mapInArrow(passed, docs.schema)
