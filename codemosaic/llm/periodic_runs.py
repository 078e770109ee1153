"""Periodic runs of words, found on a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST_WORDS, LEAST_PERIODS * q) words long, that
no neighbouring word extends keeping the period.

The words of a step's texts are numbered and laid end to end, a mark of its own after each text, so that no comparison leaves
a text. Over them stand a suffix array (by prefix doubling) with the lengths that neighbours share, and a table of range
minima over these; a longest common extension (LCE) of two places is one range minimum. For each period p the grid asks at
jp and (j+1)p how far the text agrees forward, and, in the array of the reversed texts, backward; a run of period p of so
many words covers two neighbouring grid places, so every run is met, by at most n ln n questions a text.

The first grid place in a run of L words has a forward LCE of L - 2p + 1 or more, and so of nine or more, whatever p. Where the
ranks by eight words, which doubling has made, differ, the question is not put further; the reversed array is built for the
texts that have a forward answer long enough. A multiple of a run's period finds the same stretch, so the smallest period
stands for it.

One pass over the texts: no shuffle, nothing broadcast. A step holds at most STEP_BYTES of text or one text, at about 300
bytes a word.

Defined cases: null text counts as empty; a text without words has no runs and an empty rest; rows are independent of each
other, so ties and repeated rows each get their own result; null doc_id stays null; a text of any length is searched whole; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_nothing, steps

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text in a step, and grid places that are looked at together.
STEP_BYTES, GRID = 1 << 20, 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions within a sequence of numbers whose last number stands nowhere else."""

    def __init__(self, numbers: np.ndarray):
        self.levels = self._doubled(numbers)
        self.rank = self.levels[-1]
        self.minima = self._range_minima(self._neighbours())

    def _doubled(self, numbers: np.ndarray) -> list[np.ndarray]:
        """Ranks of all suffixes by their first 1, 2, 4 .. numbers, until all differ; ``order`` is the suffix array. Only
        suffixes that still share a rank are sorted again."""
        n = len(numbers)
        order = np.argsort(numbers, kind="stable").astype(np.int32)
        slots, key, at, h, levels = np.arange(n), numbers[order].astype(np.int64), order, 1, []
        rank = np.empty(n, np.int32)
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            levels.append(rank)
            slots = slots[~(new & np.append(new[1:], True))]
            if not len(slots):
                break
            at = order[slots]
            key = rank[at].astype(np.int64) * n + rank[at + h]
            sort = np.argsort(key)
            at, key, rank, h = at[sort], key[sort], rank.copy(), 2 * h
            order[slots] = at
        self.order = order
        return levels

    def _neighbours(self) -> np.ndarray:
        """How many numbers each suffix shares with the one before it in the suffix array."""
        shared = np.zeros(len(self.order), np.int32)
        rows = np.arange(1, len(self.order))
        far = rows[self.levels[3][self.order[1:]] == self.levels[3][self.order[:-1]]] if len(self.levels) > 3 else rows[:0]
        for k in reversed(range(len(self.levels))):
            of = far if k >= 3 else rows
            a, b = self.order[of] + shared[of], self.order[of - 1] + shared[of]
            same = of[self.levels[k][a] == self.levels[k][b]]
            shared[same] += 1 << k
        return shared

    @staticmethod
    def _range_minima(of: np.ndarray) -> np.ndarray:
        table = np.empty((max(1, len(of).bit_length()), len(of)), np.int32)
        table[0] = of
        for k in range(1, len(table)):
            half = 1 << (k - 1)
            table[k] = table[k - 1]
            np.minimum(table[k - 1][:-half], table[k - 1][half:], out=table[k][:-half])
        return table

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from place a on equal those from place b on (a and b differ)."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp(high - low + 1)[1] - 1
        return np.minimum(self.minima[k, low], self.minima[k, high - (1 << k) + 1])


def _laid_out(texts: list[np.ndarray], marks_from: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end with a mark after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.int64)
    for i, (t, s) in enumerate(zip(texts, starts.tolist(), strict=True)):
        out[s : s + len(t)] = t
        out[s + len(t)] = marks_from + i
    return out, starts


def _grid(first_eight: np.ndarray, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(jp, p) where the eight words at jp and those at (j+1)p agree, of all p that a run of one text can have."""
    n = len(first_eight)
    periods = np.arange(1, n // least_periods + 1)
    counts = (n - 1) // periods
    ends = np.cumsum(counts)
    places, of = [], []
    begin = 0
    while begin < len(periods):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + GRID, "right")))
        c = counts[begin:stop]
        p = np.repeat(periods[begin:stop], c)
        at = (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)) * p
        hit = np.flatnonzero(first_eight[at] == first_eight[at + p])
        places.append(at[hit])
        of.append(p[hit])
        begin = stop
    return np.concatenate(places), np.concatenate(of)


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """For each text (its words as numbers from 0 on) the runs: rows of start, length, period by start, then period."""
    found = [np.empty((0, 3), np.int64) for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= least_words]
    if not long:
        return found
    top = 1 + max(int(texts[i].max()) for i in long)
    line, starts = _laid_out([texts[i] for i in long], top)
    ahead = Extensions(line)
    # Of a run of L words the first grid place agrees with the next for L - 2p + 1 words.
    least_ahead = lambda p: np.maximum(least_words, least_periods * p) - 2 * p + 1
    lowest = int(least_ahead(np.arange(1, least_words + 1)).min())
    level = min(3, lowest.bit_length() - 1)
    if len(ahead.levels) <= level:
        return found
    again = ahead.levels[level]
    hits = []
    for k, s in enumerate(starts.tolist()):
        own = again[s : s + len(texts[long[k]])]
        if len(np.unique(own)) < len(own):
            at, p = _grid(own, least_periods)
            if len(at):
                hits.append((np.full(len(at), k), at, p))
    if not hits:
        return found
    which, at, p = (np.concatenate(x) for x in zip(*hits, strict=True))
    forward = ahead.of(starts[which] + at, starts[which] + at + p).astype(np.int64)
    enough = forward >= least_ahead(p)
    which, at, p, forward = which[enough], at[enough], p[enough], forward[enough]
    if not len(which):
        return found
    del ahead
    asked, which = np.unique(which, return_inverse=True)
    line, starts = _laid_out([texts[long[k]][::-1] for k in asked], top)
    sizes = np.array([len(texts[long[k]]) for k in asked])[which]
    turned = starts[which] + sizes - at
    backward = Extensions(line).of(turned, turned - p).astype(np.int64)
    start, length = at - backward, backward + p + forward
    enough = length >= np.maximum(least_words, least_periods * p)
    rows = np.stack([which, start, length, p])[:, enough]
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)  # the smallest period of a stretch
    rows = rows[:, first]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    for k, own in enumerate(np.split(rows[1:].T, np.searchsorted(rows[0], np.arange(1, len(asked))))):
        found[long[asked[k]]] = own
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per document: doc_id, n_words, its runs by start, then period (word numbers from 0), and the words joined by one space
    without those that a run repeats."""
    if least_periods < 3 or least_words < 1:
        raise ValueError("runs have three periods or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for b in steps(batches, "text", STEP_BYTES):
            words = [(t or b"").split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            number: dict[bytes, int] = {}
            found = runs_of([np.array([number.setdefault(w, len(number)) for w in own], np.int64) for own in words], least_words, least_periods)
            rest = []
            for own, runs in zip(words, found, strict=True):
                rest.append(b" ".join(own if not len(runs) else [own[i] for i in np.flatnonzero(kept_words(len(own), runs))]))
            rows = np.concatenate(found)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(rest, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
