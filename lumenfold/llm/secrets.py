"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds more.

Texts are cut into tokens (runs of letters, digits and + / _ -; single marks), and each is tagged B (a secret
begins), I (it goes on) or O (outside). A token's features are its shape (kind, length, character sets, changes of
set, share of digits and of vowels, first letters), the kinds of the tokens around it, the two words before it, and features of its
file (share of digits, whether it has a key word). None of them depends on other texts.

The field learns from windows of documents chosen by a hash of their id: `TRAIN_DOCS` on average and `TRAIN_WINDOWS`
windows at most, whatever the size of the corpus. The fixed patterns label some; in part of these the key word is
replaced, so that shape and other neighbours must do. Secrets of forms that no fixed pattern knows (short assignments,
tokens of services, bearers, bare keys, passwords in urls, after options, and with marks) are planted into the others, and look-alikes (identifiers,
names and calls of programs, embedded data, account numbers, formulas, slugs, dates, versions, emails, paths) as negatives; windows with unlabelled tokens that might be secrets aren't learned from. The weights maximise the conditional log-likelihood. The best
tags come from the Viterbi recursion. A token whose score for O leads by more than all transitions could win back is O
on every best path, so the recursion runs only over the stretches between such tokens, with the same result.

Spans of fewer than `SHORT` letters count only where something announces a value. A span is drawn out over parts that hang on it by single dots, as in tokens of three parts. Spans are in code points, end exclusive. Spans of the fixed patterns always stay; spans found by the field are
added where they touch none of those.

Nulls and edge cases: a null or empty text has no spans; texts are taken whole; repeated rows are scanned each on its
own; rows with a null id are scanned like others, but not trained on; ties between tags go to O; an empty table, or
one without words in the sample, gives a field that adds nothing. Only the id and text columns are read, so other
columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.llm._planted import harmless, secret
from lumenfold.llm._text import as_texts, raw, slices

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Words that go with secrets, beside those of the fixed patterns.
HINTS = (b"pwd", b"passphrase", b"bearer", b"credential", b"authorization", b"private_key", b"access_key")
TRAIN_DOCS, TRAIN_WINDOWS, WINDOW, ROUNDS = 10_000, 3_000, 24, 60
#: How much better than O the tags of a secret must be. The field was fitted on windows with many secrets; texts have few.
CAUTION = 1.0
#: Shorter spans must be announced (bytes); longer ones may stand alone.
SHORT = 12
ANNOUNCED = re.compile(rb"""(?:[:=>]|(?:^|\s)--?[a-z][a-z-]*|\b(?:is|bearer|use|with|to|key|auth|passcode|passphrase|cred\w*|\w*(?:token|secret|pass|pwd|passwd|password)))["'\s]*$""")
#: Of one snippet, whatever its tokens are.
MOST_CHARS = 2_000
O, B, I = range(3)

_CODE = np.arange(256)
_LOWER, _UPPER, _DIGIT = (_CODE >= 97) & (_CODE <= 122), (_CODE >= 65) & (_CODE <= 90), (_CODE >= 48) & (_CODE <= 57)
_HEX = _DIGIT | ((_CODE >= 97) & (_CODE <= 102))
_JOINT = np.isin(_CODE, np.frombuffer(b"+/_-", np.uint8))
_WORD = _LOWER | _UPPER | _DIGIT | _JOINT | (_CODE >= 128)
#: 0 blank, 1 part of a word, 2 a mark
_CLASS = np.where(_WORD, 1, np.where(_CODE > 32, 2, 0)).astype(np.int8)
_SET = np.select([_LOWER | (_CODE >= 128), _UPPER, _DIGIT], [0, 1, 2], 3).astype(np.int8)
_VOWEL = np.isin(_CODE, np.frombuffer(b"aeiouyAEIOUY", np.uint8))
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))

#: Kinds of tokens
NONE, PLAIN, NUMBER, MIXED, LONG, EQUALS, COLON, QUOTE, MARK, KEYWORD, CAPITALS, JOINED = range(12)
N_KINDS = 12
#: Buckets of words (0: none).
BUCKETS = 512
#: Number of values of each feature, and where each begins in the weights; the last weight is that of the void after a text.
VALUES = (N_KINDS, 160, 12, 5, N_KINDS, N_KINDS, N_KINDS, N_KINDS, N_KINDS * N_KINDS, 8, 20, BUCKETS, BUCKETS, BUCKETS, 36)
BEGINS = np.concatenate(([0], np.cumsum(VALUES)))
VOID = int(BEGINS[-1])
_ODD, _EVEN_OUT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Tokens:
    """The tokens of the texts of one array, with what their features need."""

    def __init__(self, texts: pa.Array):
        data, bounds = raw(texts)
        self.data, self.bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        self.folded = self.data.tobytes().translate(_FOLD)
        kinds = _CLASS[self.data]
        edge = np.ones(len(kinds), bool)
        edge[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        edge[self.bounds[:-1][self.bounds[:-1] < len(kinds)]] = True
        at = np.flatnonzero(edge)
        ends = np.append(at[1:], len(kinds)) if len(at) else at
        real = kinds[at] > 0
        self.starts, self.ends = at[real], ends[real]
        self.row = np.searchsorted(self.bounds, self.starts, side="right") - 1
        self.keyed = self._keywords()

    def _keywords(self) -> np.ndarray:
        """Tokens that have a key word in them, whole."""
        hits, ends = [], []
        for word in KEYWORDS + HINTS:
            at = self.folded.find(word)
            while at >= 0:
                hits.append(at)
                ends.append(at + len(word))
                at = self.folded.find(word, at + len(word))
        out = np.zeros(len(self.starts), bool)
        if hits and len(out):
            at = np.searchsorted(self.starts, hits, side="right") - 1
            out[at[(at >= 0) & (self.ends[at] >= ends)]] = True
        return out

    def _hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Buckets from 1 on of the folded bytes from each start to its end; the same bytes give the same bucket anywhere."""
        power, back = (np.full(len(self.data) + 1, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 2**64)))
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.frombuffer(self.folded, np.uint8).astype(np.uint64) * power[:-1], dtype=np.uint64)))
        own = (total[ends] - total[starts]) * back[starts]
        own = (own ^ (own >> np.uint64(29))) * np.uint64(_EVEN_OUT)
        return 1 + ((own >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64)

    def _leads(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the last parts (after + / _ -) of the two words before each token, in its text and at most 4 tokens off; 0 for none."""
        n = len(self.starts)
        places = np.arange(len(self.data))
        joint = np.concatenate(([-1], np.maximum.accumulate(np.where(_JOINT[self.data], places, -1))))
        part = np.maximum(self.starts, joint[self.ends] + 1)
        bucket = np.append(self._hashes(np.where(part < self.ends, part, self.starts), self.ends), 0)
        word = np.concatenate(([-1], np.maximum.accumulate(np.where(mark, -1, np.arange(n)))[:-1])) if n else np.zeros(0, np.int64)
        word = np.where((word >= 0) & (np.arange(n) - word <= 4) & (self.row[word] == self.row), word, -1) if n else word
        second = np.where(word >= 0, np.append(word, -1)[word], -1)
        return bucket[word], bucket[second]

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each token are in `table`."""
        total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int32)))
        return total[self.ends] - total[self.starts]

    def features(self) -> np.ndarray:
        """A row of feature indices (into the weights) for each token."""
        n = len(self.starts)
        length = self.ends - self.starts
        lower, upper, digit, joint, hexa, vowels = map(self.count, (_LOWER | (_CODE >= 128), _UPPER, _DIGIT, _JOINT, _HEX, _VOWEL))
        sets = _SET[self.data]
        turn = np.concatenate(([0], np.cumsum(np.append(False, sets[1:] != sets[:-1]), dtype=np.int32))) if len(sets) else np.zeros(1, np.int32)
        turns = turn[self.ends] - turn[np.minimum(self.starts + 1, len(sets))]
        first = self.data[self.starts] if n else np.zeros(0, np.uint8)
        mark = _CLASS[first] == 2
        letters = lower + upper
        mixed = (letters > 0) & (digit > 0)
        kind = np.select(
            [mark & (first == 61), mark & (first == 58), mark & ((first == 34) | (first == 39)), mark, self.keyed, mixed & (length >= 12), mixed, digit == length, (upper == length) & (length >= 12), joint > 0],
            [EQUALS, COLON, QUOTE, MARK, KEYWORD, LONG, MIXED, NUMBER, CAPITALS, JOINED],
            PLAIN,
        )
        size = np.searchsorted((4, 8, 12, 16, 18, 20, 24, 32, 40), length, side="right")
        have = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (joint > 0)
        around = {step: self._near(kind, step) for step in (-3, -2, -1, 1)}
        lead, second = self._leads(mark)
        begin = self._hashes(self.starts, np.minimum(self.starts + 3, self.ends))
        digits = np.bincount(self.row, digit, len(self.bounds) - 1) / np.maximum(1, np.diff(self.bounds))
        file = np.searchsorted((0.002, 0.01, 0.05), digits) + 4 * (np.bincount(self.row, self.keyed, len(self.bounds) - 1) > 0)
        columns = (
            kind,
            size * 16 + have,
            np.searchsorted((1, 2, 3, 5, 9), turns, side="right") + 6 * (length >= 12),
            np.searchsorted((0.01, 0.25, 0.5, 0.75), digit / np.maximum(1, length)),
            around[-1],
            around[-2],
            around[-3],
            around[1],
            around[-1] * N_KINDS + around[-2],
            file[self.row],
            size + 10 * ((hexa == length) & (digit > 0) & (letters > 0)),
            lead,
            second,
            np.where(length >= 12, begin, 0),
            # names are made of words: sets change seldom, and vowels are common
            np.where(length >= 12, 1 + np.searchsorted((1.4, 1.7, 2.0, 2.4, 3.0, 4.5), length / (turns + 1), side="right") + 7 * np.searchsorted((0.12, 0.2, 0.28, 0.36), vowels / np.maximum(1, letters)), 0),
        )
        return np.stack([c + b for c, b in zip(columns, BEGINS)], axis=1).astype(np.int32) if n else np.zeros((0, len(VALUES)), np.int32)

    def _near(self, kind: np.ndarray, step: int) -> np.ndarray:
        """The kind of the token `step` places on in the same text."""
        out = np.zeros(len(kind), np.int64)
        a, b = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
        if len(kind) > abs(step):
            out[a] = np.where(self.row[a] == self.row[b], kind[b], NONE)
        return out

    def dotted(self, first: int, last: int) -> tuple[int, int]:
        """The span of tokens with what hangs on it by single dots, part by part, if that could be a part of a token too (12 letters or more, of two sets)."""

        def part(k: int) -> bool:
            own = self.data[self.starts[k] : self.ends[k]]
            return len(own) >= 12 and int(_LOWER[own].any()) + int(_UPPER[own].any()) + int(_DIGIT[own].any()) > 1

        def joined(a: int, b: int) -> bool:
            return 0 <= a and b < len(self.starts) and self.row[a] == self.row[b] and all(self.ends[k] == self.starts[k + 1] for k in range(a, b)) and self.data[self.starts[a + 1]] == 46

        while joined(last, last + 2) and part(last) and part(last + 2):
            last += 2
        while joined(first - 2, first) and part(first) and part(first - 2):
            first -= 2
        return first, last

    def trimmed(self, first: int, last: int) -> tuple[int, int]:
        """Without marks at the edges, but for those that passwords end in."""
        while first <= last and _CLASS[self.data[self.starts[first]]] == 2:
            first += 1
        while last > first and _CLASS[self.data[self.starts[last]]] == 2 and self.data[self.starts[last]] not in b"!@#$%&*?":
            last -= 1
        return first, last

    def announced(self, k: int) -> bool:
        """Whether something before a token says that a value comes: a colon, equals sign or arrow, an option, or a word for it."""
        low = max(int(self.bounds[self.row[k]]), int(self.starts[k]) - 40)
        return ANNOUNCED.search(self.folded[low : int(self.starts[k])]) is not None

    def base(self) -> list[tuple[int, int, int, int, int]]:
        """(row, kind, start, end, start of the secret itself) of each match of the fixed patterns, in bytes."""
        found = []
        for row in self._rows_with(self.folded, KEYWORDS):
            low, text = int(self.bounds[row]), self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()
            found += [(row, 0, low + m.start(), low + m.end(), low + m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        for row in self._rows_with(self.data.tobytes(), (b"AKIA",)):
            low, text = int(self.bounds[row]), self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()
            found += [(row, 1, low + m.start(), low + m.end(), low + m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        hexa = np.concatenate(([False], _HEX[self.data], [False]))
        cuts = self.bounds[1:-1]
        starts = np.union1d(np.flatnonzero(hexa[1:-1] & ~hexa[:-2]), cuts[hexa[1:][cuts]] if len(self.data) else cuts[:0])
        ends = np.union1d(np.flatnonzero(hexa[1:-1] & ~hexa[2:]) + 1, cuts[hexa[cuts]])
        long = np.flatnonzero(ends - starts >= 16)
        rows = np.searchsorted(self.bounds, starts[long], side="right") - 1
        return found + [(int(r), 2, int(a), int(b), int(a)) for r, a, b in zip(rows, starts[long], ends[long])]

    def _rows_with(self, text: bytes, words: tuple[bytes, ...]) -> list[int]:
        rows = set()
        for word in words:
            at = text.find(word)
            while at >= 0:
                row = int(np.searchsorted(self.bounds, at, side="right")) - 1
                if at + len(word) <= self.bounds[row + 1]:
                    rows.add(row)
                at = text.find(word, at + 1)
        return sorted(rows)

    def points(self, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places in bytes as code points from the beginning of their text."""
        total = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)))
        return total[places] - total[self.bounds[rows]]


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of exponentials along a short axis."""
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(features: np.ndarray, tags: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of `tags` (windows x length), and its slopes by weights and by transitions.

    Windows begin and end as after and before an O, as texts do.
    """
    n, length, _ = features.shape
    gold = np.eye(3)[tags]
    scores = sum(weights[column] for column in np.moveaxis(features, 2, 0))
    forward, backward = np.empty_like(scores), np.empty_like(scores)
    forward[:, 0] = scores[:, 0] + moves[O]
    for t in range(1, length):
        forward[:, t] = scores[:, t] + _summed(forward[:, t - 1, :, None] + moves, axis=1)
    backward[:, -1] = moves[:, O]
    for t in range(length - 2, -1, -1):
        backward[:, t] = _summed(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
    total = _summed(forward[:, -1] + moves[:, O], axis=1)
    share = np.exp(forward + backward - total[:, None, None])
    both = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[:, None, None, None])
    told = (gold * scores).sum() + moves[tags[:, :-1], tags[:, 1:]].sum() + moves[O, tags[:, 0]].sum() + moves[tags[:, -1], O].sum()
    miss, slope = (gold - share).reshape(-1, 3), np.zeros_like(weights)
    for column in features.reshape(-1, features.shape[2]).T:
        for tag in range(3):
            slope[:, tag] += np.bincount(column, miss[:, tag], len(weights))
    turns = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:]) - both.sum(axis=(0, 1))
    turns[O] += (gold - share)[:, 0].sum(axis=0)
    turns[:, O] += (gold - share)[:, -1].sum(axis=0)
    return float(told - total.sum()), slope, turns


def train(features: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the log-likelihood of `tags`, less a small square penalty."""
    weights, moves = np.zeros((VOID + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (weights, moves)]
    for _ in range(rounds):
        _, *slopes = likelihood(features, tags, weights, moves)
        for x, s, d in zip((weights, moves), state, slopes):
            d = d - 0.05 * x
            s += d * d
            x += 0.5 * d / np.sqrt(s + 1e-9)
    return weights, moves


def lessons(snippets: list[str], secretive: list[str], count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """`count` texts with the places of their secrets, in code points: from `secretive`, which have matches of the fixed patterns, and
    from `snippets` with planted secrets and look-alikes. They depend on these and the seed only."""
    r, out = Random(seed), []
    for k in range(count):
        if secretive and k % 4 == 0:
            text = secretive[k // 4 % len(secretive)]
            marked = [(x[3], x[2]) for x in scan(pa.array([text], pa.large_string()), None)[0]]
            if r.random() < 0.5 and len(marked) == 1:  # with another word, or none, before it
                at, end = marked[0]
                word = re.search(r"""\S+\s*[:=]?\s*["']?$""", text[:at])
                lead = r.choice(("", "", secret(r)[0]))
                before = (text[: word.start()] if word else text[:at]) + lead
                text, marked = before + text[at:], [(len(before), len(before) + end - at)]
        else:
            text, marked = snippets[k % len(snippets)] if snippets else "", []
            cuts = [m.end() for m in re.finditer(r"\s+", text)] or [len(text)]
            for _ in range(r.choice((1, 1, 2))):
                at = r.choice(cuts)
                before, own, after = secret(r) if r.random() < 0.5 else (harmless(r), "", "")
                if any(a < at < b for a, b in marked):
                    continue
                gap = " " if at and not text[at - 1].isspace() else ""
                new = f"{gap}{before}{own}{after} "
                marked = [(a + len(new), b + len(new)) if a >= at else (a, b) for a, b in marked]
                text = text[:at] + new + text[at:]
                cuts = [c + len(new) if c >= at else c for c in cuts]
                if own:
                    marked.append((at + len(gap) + len(before), at + len(gap) + len(before) + len(own)))
            marked += [(x[3], x[2]) for x in scan(pa.array([text], pa.large_string()), None)[0]]
        out.append((text, sorted(marked)))
    return out


def windows_of(told: list[tuple[str, list[tuple[int, int]]]], seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a window of each text, about its first secret if it has any; shorter texts are filled up with void."""
    texts = pa.array([t for t, _ in told], pa.large_string())
    tokens, r = Tokens(texts), Random(seed)
    own = np.vstack([tokens.features(), np.full((1, len(VALUES)), VOID, np.int32)])
    begins = np.searchsorted(tokens.row, np.arange(len(told) + 1))
    features, tags = np.full((len(told), WINDOW, len(VALUES)), VOID, np.int32), np.zeros((len(told), WINDOW), np.int64)
    ends = tokens.points(tokens.ends, tokens.row)
    starts = tokens.points(tokens.starts, tokens.row)
    for k, (_, marked) in enumerate(told):
        low, high = int(begins[k]), int(begins[k + 1])
        tag = np.zeros(high - low, np.int64)
        for a, b in marked:
            x, y = np.searchsorted(ends[low:high], a, side="right"), np.searchsorted(starts[low:high], b)
            tag[x:y], tag[x : x + 1] = I, B
        first = int(np.flatnonzero(tag == B)[0]) if (tag == B).any() else r.randrange(max(1, high - low))
        at = min(max(0, first - r.randrange(4, WINDOW - 4)), max(0, high - low - WINDOW))
        size = min(WINDOW, high - low - at)
        features[k, :size], tags[k, :size] = own[low + at : low + at + size], tag[at : at + size]
    return features, tags


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of a stretch that has an O, or the edge of the text, on both sides."""
    best = scores[0] + moves[O]
    back = np.zeros((len(scores), 3), np.int64)
    for t in range(1, len(scores)):
        ways = best[:, None] + moves
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = (best + moves[:, O]).argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t][tags[t]]
    return tags


def tagged(features: np.ndarray, rows: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The tag of each token. Texts begin and end as after and before an O."""
    scores = np.zeros((len(features), 3))
    for column in features.T:
        scores += weights[column]
    scores[:, B] -= CAUTION
    settled = scores[:, O] - scores[:, 1:].max(axis=1, initial=-np.inf) > 2 * (moves.max() - moves.min())
    tags = np.zeros(len(scores), np.int64)
    open_ = np.flatnonzero(~settled)
    if len(open_):
        breaks = np.flatnonzero((np.diff(open_) > 1) | (np.diff(rows[open_]) > 0)) + 1
        for part in np.split(open_, breaks):
            tags[part] = viterbi(scores[part], moves)
    return tags


def scan(texts: pa.Array, model: tuple[np.ndarray, np.ndarray] | None) -> list[list[tuple[int, str, int, int]]]:
    """For each text its spans as (start, kind, end, start of the secret itself), in order."""
    tokens = Tokens(texts)
    found = tokens.base()
    if model is not None and len(tokens.starts):
        tags = tagged(tokens.features(), tokens.row, *model)
        begins = np.flatnonzero(((tags == B) | ((tags == I) & ((np.append(O, tags[:-1]) == O) | (np.diff(tokens.row, prepend=-1) > 0)))))
        inside = tags > O
        for at in begins:
            last = at
            while last + 1 < len(tags) and tags[last + 1] == I and tokens.row[last + 1] == tokens.row[at]:
                last += 1
            if inside[at]:
                first, last = tokens.trimmed(at, last)
                if first > last:
                    continue
                first, last = tokens.dotted(first, last)
                if tokens.ends[last] - tokens.starts[first] < SHORT and not tokens.announced(first):
                    continue
                found.append((int(tokens.row[at]), 3, int(tokens.starts[first]), int(tokens.ends[last]), int(tokens.starts[first])))
    if not found:
        return [[] for _ in range(len(texts))]
    held = np.array(found, np.int64)
    rows = held[:, 0]
    points = np.stack([tokens.points(held[:, k], rows) for k in (2, 3, 4)], axis=1)
    out: list[list[tuple[int, str, int, int]]] = [[] for _ in range(len(texts))]
    by_row: dict[int, list[tuple[int, int, int, int]]] = {}
    for (row, kind, *_), (start, end, own) in zip(found, points.tolist()):
        by_row.setdefault(row, []).append((start, kind, end, own))
    for row, spans in by_row.items():
        fixed = sorted(s for s in spans if s[1] < 3)
        begins, reach = [s[0] for s in fixed], list(accumulate((s[2] for s in fixed), max))
        spans = fixed + [s for s in spans if s[1] == 3 and not ((k := bisect_left(begins, s[2])) and reach[k - 1] > s[0])]
        out[row] = [(start, KINDS[kind], end, own) for start, kind, end, own in sorted(spans)]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """The weights and transitions, from snippets that tasks cut and the driver gathers (`TRAIN_WINDOWS` at most, of `MOST_CHARS` at most)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    total = rows.count()
    part = int(2**20 * min(1.0, train_docs / max(1, total)))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of `WINDOW` tokens: one with the first match of a fixed pattern of a text, and one at a place that its length gives.

        Parts with anything else that mixes letters and digits are passed over, as nobody says that it is no secret.
        """
        for batch in batches:
            for piece in slices(batch, "text"):
                tokens = Tokens(as_texts(piece.column("text")))
                rows, first, count = np.unique(tokens.row, return_index=True, return_counts=True)
                doubtful, match = np.isin(tokens.features()[:, 0], (MIXED, LONG)) & (tokens.ends - tokens.starts >= 8), {}
                for row, _, _, end, own in sorted(tokens.base(), reverse=True):
                    match[row] = own
                    doubtful[np.searchsorted(tokens.ends, own, side="right") : np.searchsorted(tokens.starts, end)] = False
                doubts = np.concatenate(([0], np.cumsum(doubtful)))
                found = []
                for row, low, n in zip(rows.tolist(), first.tolist(), count.tolist()):
                    size = min(n, WINDOW)
                    at = np.arange(low, low + n - size + 1)
                    own = np.searchsorted(tokens.ends, match.get(row, 0), side="right")
                    sure = doubts[at + size] == doubts[at]
                    # the first window from a place that the length gives, and one with the match
                    turn = (at - low - (n * 2_654_435_761 >> 7)) % len(at)
                    places = [(at[sure][turn[sure].argmin()], False)] if sure.any() else []
                    if row in match and (sure := sure & (at <= own) & (own < at + size)).any():
                        places.append((at[sure][abs(at[sure] + size // 2 - own).argmin()], True))
                    for begin, secretive in places:
                        a, b = tokens.starts[begin], tokens.ends[begin + size - 1]
                        found.append((tokens.data[a:b].tobytes().decode()[:MOST_CHARS], secretive))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.bool_())], names=["snippet", "secretive"])

    snippets = shared_checkpoint(chosen.mapInArrow(cut, "snippet string, secretive boolean").distinct())  # some MB; both sorts read it
    # by hash; only the first of each task travel
    known, plain = ([r.snippet for r in snippets.where(F.col("secretive") == flag).orderBy(F.xxhash64("snippet"), "snippet").limit(TRAIN_WINDOWS // 2).collect()] for flag in (True, False))
    if not plain:
        return None
    weights, moves = train(*windows_of(lessons(plain, known, TRAIN_WINDOWS)))
    return weights.astype(np.float32), moves.astype(np.float32)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`: an array of (start, kind, end, secret_start) for each document. A map; no shuffle beside the fit."""
    model = fit(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("secret_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = scan(as_texts(part.column("text")), model)
                spans = [[dict(zip(("start", "kind", "end", "secret_start"), s)) for s in row] for row in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "found"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<start:long,kind:string,end:long,secret_start:long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with all their columns, each secret in the texts replaced by `mark`, and the lengths set anew."""
    model = fit(docs, id_col, text_col)

    def clean(text: str | None, spans: list[tuple[int, str, int, int]]) -> str | None:
        if text is None or not spans:
            return text
        out, done = [], 0
        for own, end in sorted((s[3], s[2]) for s in spans):
            if own >= done:
                out += [text[done:own], mark]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(text_col)
                texts = [clean(t, s) for t, s in zip(column.to_pylist(), scan(as_texts(column), model))]
                yield part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(texts, column.type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else cleaned
