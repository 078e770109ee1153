"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over consecutive words ignore some positions, so a passage whose words were partly replaced still shares
hashes with its benchmark item wherever the kept positions agree. Words are runs of letters, digits and underscores in
lower case; of scripts that put no spaces between words every character is a word.

Each block of benchmark items becomes a table of seed hashes (mask, words at its kept positions -> place in the items). Documents
are joined with it by hash; around every hit the words of document and item are compared one by one. A
document is contaminated by an item if WINDOW consecutive words of the item (all of them, if it has fewer) stand
in a row with at least SHARE of them equal; of 8 to 10 words one may differ, of fewer none (``needed``). The masks find every
such place: no choice of so many substitutions escapes all of them.

The benchmark is a stated query set: its size is taken first, it is split into blocks of at most BLOCK_CHARS characters
(one block in common cases), and each block alone is collected and sent to the workers, which hold about 60 bytes a word of
it, once each. One block is met in one pass over the documents without any shuffle, so no document, source or passage can be
hot. Of several blocks each is a pass that gives the hits of its items by the hash of the text, and these are joined with the
documents at the end. Hits are compared HITS at a time, however many items share a phrase.

Defined cases: null text counts as empty, and so never matches; every item of one word or more counts, short ones where all
their words stand in a row (items of fewer than ``least_words`` words are passed over where that is asked for); equal
items all count; a very long document or item is one (an item longer than a block is a block of its own); repeated rows each
get their result; an empty benchmark contaminates nothing, an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_few, kept_in_worker, steps, texts_of

#: 1: the word counts. All have five ones; different spans and gaps, chosen for few common shifts.
MASKS = ("11111", "1101011", "11010011", "1010011001")
WINDOW, SHARE, MIN_WORDS, BLOCK_CHARS = 13, 0.8, 5, 4_000_000
#: Words that an item has at least; every item counts unless more are asked for.
LEAST_WORDS = 1
#: Hits that are compared at once.
HITS = 20_000

#: Characters that are words of their own: kana, Han, Thai, Lao, Burmese, Khmer.
_ALONE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_PLAIN, _SPACELESS = re.compile(r"\w+"), re.compile(f"[{_ALONE}]")
_WORD = re.compile(rf"[^\W{_ALONE}]+|(?=\w)[{_ALONE}]")
#: All masks: those above, and rows of 1 to 4 words for items that have no more.
_MASKS = [*MASKS, *("1" * n for n in range(1, MIN_WORDS))]
_FACTORS = np.random.default_rng(977).integers(1, 1 << 63, (len(_MASKS), 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in _MASKS]
#: Places around a hit that a window over it can reach, and as many between texts.
_AROUND = np.arange(1 - WINDOW, WINDOW)
_GAP = [-1] * (2 * WINDOW)


def needed(size: int) -> int:
    """How many of so many words must be equal. Below 11 words it is more than SHARE: as many as the masks find without fail."""
    return size - (0 if size < 8 else 1 if size < 11 else int(size * (1 - SHARE) + 1e-9))


def words(text: str) -> list[str]:
    text = text.lower()
    return (_PLAIN if text.isascii() or not _SPACELESS.search(text) else _WORD).findall(text)


def seed_hashes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes under mask k, of windows whose kept words all have an id (0 or more)."""
    n = len(ids) - len(_MASKS[k]) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids >= 0
    here = known[:n].copy()
    for o in _OFFSETS[k][1:]:
        here &= known[o : o + n]
    at = np.flatnonzero(here)
    h = np.zeros(len(at), np.uint64)
    for o, f in zip(_OFFSETS[k], _FACTORS[k], strict=False):
        x = (ids[at + o].astype(np.uint64) + np.uint64(1)) * f
        h += x ^ (x >> np.uint64(29))
    return at, h


class SeedTable:
    """The seeds of a block of items, in flat arrays, and the comparison around hits."""

    def __init__(self, items: list[tuple[int, str]], least_words: int = LEAST_WORDS, most: int = 100_000):
        kept, hashes, number = [], [], {}
        for item_id, text in items:
            w = words(text)
            if len(w) >= max(1, least_words):
                kept.append((item_id, len(w)))
                hashes.append(np.array([number[x] if x in number else number.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in w], np.uint64))
                if len(number) > most:
                    number.clear()
        self.items = np.array([i for i, _ in kept], np.int64)
        self.sizes = np.array([n for _, n in kept], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.needed = np.array([needed(min(WINDOW, n)) for n in self.sizes.tolist()], np.int64)
        self.vocabulary, flat = np.unique(np.concatenate(hashes), return_inverse=True) if kept else (np.empty(0, np.uint64), np.empty(0))
        self.flat = flat.astype(np.int32)
        self.seeds = [self._seeds(k) for k in range(len(_MASKS))]
        self.known: dict[str, int] = {}  # words of documents seen before -> place in the vocabulary, or -1
        self.most = most

    def _seeds(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes under mask k, ascending, and where in the items they begin; not across items."""
        span = len(_MASKS[k])
        at, h = seed_hashes(self.flat, k)
        item = np.searchsorted(self.offsets, at, "right") - 1
        fits = at + span <= (self.offsets + self.sizes)[item]
        fits &= (self.sizes[item] == span) if span < MIN_WORDS else (self.sizes[item] >= MIN_WORDS)
        at, h = at[fits], h[fits]
        order = np.argsort(h, kind="stable")
        return h[order], at[order].astype(np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as places in the vocabulary (-1 for others), with gaps between, and where each text begins."""
        split = [words(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list({w for own in split for w in own if w not in self.known})
        if new:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            self.known.update(zip(new, np.where(self.vocabulary[at] == h, at, -1).tolist(), strict=True))
        ids, starts = [*_GAP], []
        for own in split:
            starts.append(len(ids))
            ids += map(self.known.__getitem__, own)
            ids += _GAP
        return np.array(ids, np.int32), np.array(starts)

    def overlaps(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text, (item_id, best share of equal words in a window) of the items that contaminate it."""
        out: list[dict[int, float]] = [{} for _ in texts]
        if len(self.items):
            ids, starts = self._ids(texts)
            for k, (h, place) in enumerate(self.seeds):
                if not len(h):
                    continue
                at, own = seed_hashes(ids, k)
                lo = np.searchsorted(h, own)
                hit = h[np.minimum(lo, len(h) - 1)] == own
                at, lo = at[hit], lo[hit]
                n = np.searchsorted(h, own[hit], "right") - lo
                ends = np.cumsum(n)
                for first in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                    i = np.arange(first, min(first + HITS, int(ends[-1])))
                    of = np.searchsorted(ends, i, "right")
                    self._compare(ids, starts, at[of], place[lo[of] + i - (ends - n)[of]].astype(np.int64), out)
        return [sorted(x.items()) for x in out]

    def _compare(self, ids: np.ndarray, starts: np.ndarray, at: np.ndarray, place: np.ndarray, out: list[dict[int, float]]) -> None:
        """Put into out what the windows over these hits (in texts, in items) find. A window that reaches beyond its item is never
        better than the one that ends with it."""
        item = np.searchsorted(self.offsets, place, "right") - 1
        around = place[:, None] + _AROUND
        inside = (around >= self.offsets[item, None]) & (around < (self.offsets + self.sizes)[item, None])
        equal = inside & (self.flat[np.clip(around, 0, len(self.flat) - 1)] == ids[at[:, None] + _AROUND])
        sums = np.zeros((len(at), len(_AROUND) + 1), np.int64)
        np.cumsum(equal, axis=1, out=sums[:, 1:])
        size = self.sizes[item]
        most = np.where(size < WINDOW, sums[:, -1], (sums[:, WINDOW:] - sums[:, :-WINDOW]).max(axis=1))
        good = most >= self.needed[item]
        text = np.searchsorted(starts, at[good], "right") - 1
        pair, which = np.unique(text * len(self.items) + item[good], return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, which, most[good] / np.minimum(WINDOW, size[good]))
        for x, share in zip(pair.tolist(), best.tolist(), strict=True):
            t, i = divmod(x, len(self.items))
            out[t][int(self.items[i])] = max(share, out[t].get(int(self.items[i]), 0.0))


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of bounded size the items make, and the blocks; each is collected by itself."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    block = lambda b: items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    return n, ([(r[0], r[1]) for r in block(b).orderBy("item_id", "text").collect()] for b in range(n))


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())]))


def _with_hits(rows: DataFrame, text_at: int, items: list[tuple[int, str]], least_words: int) -> DataFrame:
    """The rows with one more column, contaminated_by, for one block of items."""
    schema = T.StructType([*rows.schema.fields, T.StructField("contaminated_by", _FOUND)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
    shared, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_in_worker(name, lambda: SeedTable(shared.value, least_words))
        for b in steps(batches, text_at, most=1 << 20):
            found = [[{"item_id": i, "share": s} for i, s in x] for x in table.overlaps(texts_of(b.column(text_at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], schema.names)

    return rows.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_at: int, block_chars: int = BLOCK_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, its columns renamed c0, c1, ..., with one more, contaminated_by: array of (item_id, share), empty for
    clean documents. text_at: the place of the text column."""
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    n, blocks = _blocks(benchmark, block_chars)
    none = F.array().cast(_FOUND)
    if n <= 1:
        return _with_hits(out, text_at, next(blocks), least_words) if n else out.withColumn("contaminated_by", none)
    node = F.unhex(F.md5(F.coalesce(F.col(f"c{text_at}"), F.lit("")).cast("binary"))).alias("node")
    hits = None
    for items in blocks:
        found = _with_hits(out.select(node, F.col(f"c{text_at}").alias("text")), 1, items, least_words).select("node", F.explode("contaminated_by").alias("hit"))
        hits = found if hits is None else hits.union(found)
    best = hits.groupBy("node", "hit.item_id").agg(F.max("hit.share").alias("share"))
    best = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("item_id", "share"))).alias("contaminated_by"))
    return out.withColumn("node", node).join(broadcast_if_few(best, "hits"), "node", "left").drop("node").withColumn("contaminated_by", F.coalesce("contaminated_by", none))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates."""
    found = find_overlaps(docs, benchmark, docs.columns.index("text")).where(F.size("contaminated_by") == 0)
    return found.drop("contaminated_by").toDF(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, the items (ascending), and the largest share of equal words in a window."""
    found = find_overlaps(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, 1)
    return found.select(
        F.col("c0").alias("doc_id"), (F.size("contaminated_by") > 0).alias("contaminated"),
        F.array_sort(F.col("contaminated_by.item_id")).alias("item_ids"), F.coalesce(F.array_max("contaminated_by.share"), F.lit(0.0)).alias("best_share"),
    )
