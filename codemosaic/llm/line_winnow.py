"""Line deduplication by winnowing over line hashes.

A run is a stretch of consecutive lines of one document. A run of at least RUN_WORDS words that stands earlier in the
corpus (documents in the order of doc_id and text hash, lines in order) is deleted where it comes again; shorter
repeats, such as a licence line, stay.

1. Each document slides a window over its lines, the shortest stretch from each line that holds RUN_WORDS words, and
   selects the smallest line hash in it (the rightmost of equals). A run of RUN_WORDS words holds such a window whole, so
   its copies select the same line: a guaranteed fingerprint. Only fingerprints and their positions are stored.
2. Positions are joined by fingerprint: those whose fingerprint stands nowhere else go. The others are taken back to their
   documents and extended both ways over the lines around them, as far as the shortest stretches of RUN_WORDS words that
   selected them; stretches are told apart by a 128-bit hash. Every line of a repeated run lies in such a stretch that
   repeats, and any longer run is a union of them, so bounded extension loses nothing and no two copies of a popular passage
   need be paired. What no joined position reaches is never looked at.
3. Each stretch's earliest position is an aggregate; later ones are deleted, and deletions meet their document by key.

Positions and deletions are sent to the documents as long as they are few in bytes, which are summed; beyond that both sides
are dealt out by document.

Defined cases: null text counts as empty and stays null; rows equal in doc_id and text are one document and get the
same result; null doc_id comes first in the order; a text of any length is one document, a line of any length is one line; an empty table gives an empty table; other columns are kept as they
are (n_chars, if there, is counted anew), whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_few, materialize, steps, texts_of

#: Words (of [^\x20\x09-\x0D]+) that a run has at least.
RUN_WORDS = 50

MARKS = "own_id long, own_hash long, mark long, line int"
STRETCHES = "own_id long, own_hash long, stretch binary, start int, end int"


class Lines:
    """The lines of a text and the stretches of least words that winnowing slides over."""

    def __init__(self, data: bytes, least: int = RUN_WORDS):
        self.data, self.lines = data, data.split(b"\n")
        self.words = [len(x.split()) for x in self.lines]
        self.spans: dict[tuple[int, int], int] = {}  # (first line, last line) -> the line that is its fingerprint
        if sum(self.words) >= least:
            self.hashes = [xxhash.xxh3_64_intdigest(x) for x in self.lines]
            self._slide(least)

    def _slide(self, least: int) -> None:
        """Every shortest stretch from a line on, and back from a line, with its fingerprint: the smallest line hash of the
        window that begins where it begins."""
        words, hashes, n = self.words, self.hashes, len(self.lines)
        anchor: list[int] = []
        low: deque[int] = deque()  # positions whose hashes rise; the first is the window's smallest
        j = total = 0
        for i in range(n):
            while total < least and j < n:
                while low and hashes[low[-1]] >= hashes[j]:
                    low.pop()
                low.append(j)
                total += words[j]
                j += 1
            if total < least:
                break
            while low[0] < i:
                low.popleft()
            anchor.append(low[0])
            self.spans[i, j - 1] = low[0]
            total -= words[i]
        i = total = 0
        for j in range(n):
            total += words[j]
            while total - words[i] >= least:
                total -= words[i]
                i += 1
            if total >= least:
                self.spans.setdefault((i, j), anchor[i])

    def fingerprints(self) -> list[tuple[int, int]]:
        """(hash, line) of every line that is a fingerprint."""
        return [(self.hashes[s] - (1 << 63), s) for s in sorted({*self.spans.values()})]

    def extended(self, positions: list[int]) -> list[tuple[bytes, int, int]]:
        """(hash, first line, last line) of the stretches that selected one of these lines."""
        at = [0]
        for x in self.lines:
            at.append(at[-1] + len(x) + 1)
        own = {*positions}
        return [(xxhash.xxh3_128_digest(self.data[at[i] : at[j + 1] - 1]), i, j) for (i, j), s in self.spans.items() if s in own]


def _keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """The columns that name a document in the order, its text, and more."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"), "text", *more)


_KEY = ["own_id", "own_hash"]


def _each(rows: DataFrame, schema: str, of: Callable[[Lines, list[int] | None], list[tuple]], least: int) -> DataFrame:
    """What ``of`` makes of each text's lines (and joined positions, if there), under the document's names."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            places = b.column("positions").to_pylist() if "positions" in b.schema.names else [None] * b.num_rows
            found = [(d, h, *x) for d, h, t, p in zip(b.column("own_id").to_pylist(), b.column("own_hash").to_pylist(), texts_of(b.column("text")), places, strict=True) for x in of(Lines(t.encode(), least), p)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def joined_positions(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """own_id, own_hash, positions: the lines of each document whose fingerprint stands at another position too."""
    marks = materialize(_each(_keyed(docs), MARKS, lambda lines, _: lines.fingerprints(), least), "marks")
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    return marks.join(broadcast_if_few(shared, "shared"), "mark", "left_semi").groupBy(*_KEY).agg(F.collect_set("line").alias("positions"))


def repeated_stretches(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """own_id, own_hash, start, end of every stretch that stands earlier in the corpus."""
    # A repeated row adds nothing: its stretches stand where those of its equal stand.
    near = _keyed(docs).join(broadcast_if_few(joined_positions(docs, least), "positions"), _KEY)
    found = materialize(_each(near, STRETCHES, lambda lines, positions: lines.extended(positions), least), "stretches")
    place = F.struct("own_id", "own_hash", "start")
    earliest = found.groupBy("stretch").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("stretch", "earliest")
    return found.join(broadcast_if_few(earliest, "earliest"), "stretch").where(place > F.col("earliest")).select(*_KEY, "start", "end")


def _deletions(docs: DataFrame, least: int) -> DataFrame:
    """own_id, own_hash, spans (start, end) of every document that loses lines."""
    return broadcast_if_few(repeated_stretches(docs, least).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def _without(text: str | None, spans: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the lines in these spans, its lines before, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not spans:
        return text, len(lines), 0
    gone = bytearray(len(lines))
    for s in spans:
        gone[s["start"] : s["end"] + 1] = b"\1" * (s["end"] + 1 - s["start"])
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)


def _cut(docs: DataFrame, least: int) -> DataFrame:
    """kept (a struct of the columns other than text), text without repeated runs, n_lines before, n_removed lines."""
    kept = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    named = docs.select(kept.alias("kept"), "doc_id", "text")
    joined = _keyed(named, "kept").join(_deletions(docs, least), _KEY, "left").select("kept", "text", "spans")
    schema = T.StructType([joined.schema["kept"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = [_without(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            text, before, gone = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(text, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """Per document: doc_id, text without repeated runs, n_lines before, n_removed lines."""
    return _cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least).select("kept.doc_id", "text", "n_lines", "n_removed")


def dedup_lines_stage(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """The documents with all their columns; text is without repeated runs and n_chars follows it."""
    out = _cut(docs, least)
    return out.select(*[F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("kept")[c].alias(c) for c in docs.columns])
