"""Repeated passages by a logarithmic family of suffix arrays.

Texts are bytes. A byte goes if a string of RUN bytes that covers it also starts earlier in the corpus (documents in the order
of doc_id and text hash, starts in order); strings are judged on the input, overlaps count.

Documents come in batches, in order. A batch gets suffix arrays, which are scanned by merging against the arrays of the
levels that are there; then it becomes a level itself, and levels of equal size are merged, so n batches lie in about log n
levels and each entry is rewritten about log n times. An array is a table sorted and bucketed by key, so that a merge scan
moves no level; a level keeps one row for each distinct key: the key, what stands there, and the first document with it.

The arrays are sparse. Each string of RUN bytes picks, by content, one place in it: the first of the smallest hashes of
its SEED-byte strings. Consecutive strings mostly pick the same place, so one entry stands for up to RUN - SEED + 1 strings,
about one entry for 32 bytes. Suffixes are ordered by a hash of their first bytes, not by alphabet; a merge scan asks
only that both sides agree. An entry has two hashes: ``core`` of the bytes that all of its strings share, which is its key,
and ``whole`` of all bytes that they cover. Equal strings lie in entries of equal core, so in a scan

- a core that is met for the first time removes nothing;
- if all entries of a core are equal as a whole, all but the first are repeats;
- else contents are looked up by themselves, in arrays of their own; all but the first of each are repeats, and the first
  ones are told apart more finely, by arrays of the next kind: entries, then blocks of BLOCK strings (whose core is nearly
  the string), then strings. An older document whose entry stood alone until now is read once more for this.

Cores are 64-bit hashes and wholes other ones of WHOLE bits, so contents are told apart by 104 bits. No two copies of a passage are ever
paired, and rows are keyed by content: before a shuffle, those of one key become one row a task.

What goes back to the texts (keys that are met again, spans) is broadcast as long as it is few in bytes, and joined by a shuffle
beyond that; which of the two runs changes no result.

Defined cases: null text counts as empty; texts of fewer than RUN bytes lose nothing; rows equal in doc_id and text are one
document and get the same result; null doc_id comes first in the order; a text of any length is one document, read in blocks
of bounded size; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_few, delete_path, keep_nothing, materialize, scratch_path, steps

#: Bytes of the strings that are looked for, of those that pick places, and strings in a block.
RUN, SEED, BLOCK = 100, 32, 8
#: Batches that a table is dealt into.
BATCHES = 4
#: Bits of the hash of a whole; those of strings, whose core is the string itself, need fewer. What is shuffled is mostly hashes.
WHOLE, WHOLE_OF_STRING = 40, 24
#: Bytes of text in a step, and of a block that numpy looks at together (places within it take 23 bits).
STEP_BYTES, PIECE = 1 << 19, 1 << 22

ENTRIES = "core long, whole long, own_id long, tie long, at int, n int, again boolean, root long"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 23) - 1)


def _seeds(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on (SEED is a power of two)."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while width < SEED:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        h = h * _MIX
        h ^= h >> np.uint64(32)
        return h * _MIX


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    w = 1
    while 2 * w <= width:
        values, w = np.minimum(values[:-w], values[w:]), 2 * w
    return np.minimum(values[: len(values) - (width - w)], values[width - w :]) if w < width else values


def _picked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all strings of RUN bytes within the documents [start, end): where entries' strings begin, how many they are, the picked
    place and its hash. The bytes are looked at in blocks; an entry at a block's end may come in two, which are told apart as any others."""
    first, count, place, core = [], [], [], []
    edge = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= RUN
    edge[starts[long]] += 1
    edge[ends[long] - RUN + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    for begin in range(0, max(0, len(data) - RUN + 1), PIECE):
        piece = data[begin : begin + PIECE + RUN - 1]
        h = _seeds(piece)
        low = _smallest((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), RUN - SEED + 1)
        own = np.flatnonzero(inside[begin : begin + len(low)])
        if not len(own):
            continue
        at = (low[own] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)]))
        first.append(own[new] + begin)
        count.append(np.diff(np.append(new, len(own))))
        place.append(at[new] + begin)
        core.append(h[at[new]].view(np.int64))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (first, count, place, core))


class Pieces:
    """Entries, blocks and strings of a step's documents, as rows of (document, core, whole, at, n, root)."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.first, self.count, self.place, self.core = _picked(np.frombuffer(self.bytes, np.uint8), self.starts, self.ends)
        self.document = np.searchsorted(self.ends, self.first, "right")

    def _rows(self, document: np.ndarray, core: np.ndarray, first: np.ndarray, n: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, ...]:
        data, digest, drop = self.bytes, xxhash.xxh3_64_intdigest, 64 - WHOLE
        whole = np.array([digest(data[a:z]) >> drop for a, z in zip(first.tolist(), (first + n - 1 + RUN).tolist(), strict=True)], np.int64)
        return document, core, whole, first - self.starts[document], n, root

    def entries(self) -> tuple[np.ndarray, ...]:
        return self._rows(self.document, self.core, self.first, self.count, np.zeros(len(self.core), np.int64))

    def finer(self, wanted: list[dict[int, set[int]]], strings: bool) -> tuple[np.ndarray, ...]:
        """The blocks of each document's wanted entries (by their cores), or the strings of its wanted blocks (cores of blocks by
        those of entries)."""
        data, rows = self.bytes, []
        among = np.unique(np.fromiter((root for own in wanted for root in own), np.int64))
        for i in np.flatnonzero(np.isin(self.core, among)).tolist():
            d, root = int(self.document[i]), int(self.core[i])
            if root not in wanted[d]:
                continue
            place, s, end = int(self.place[i]), int(self.first[i]), int(self.first[i] + self.count[i])
            while s < end:
                k = (place - s) // BLOCK  # strings of one block begin from k * BLOCK bytes on before the place
                stop = min(end, place - k * BLOCK + 1)
                last = min(k * BLOCK + BLOCK - 1, RUN - SEED)
                block = xxhash.xxh3_64_intdigest(data[place - k * BLOCK : place - last + RUN], k + 1)
                if not strings:
                    rows.append((d, block, s, stop - s, root))
                elif block - (block >> 63 << 64) in wanted[d][root]:
                    rows.append((d, s, stop - s))
                s = stop
        if strings:
            return self._strings(*np.array(rows, np.int64).reshape(-1, 3).T)
        document, core, first, n, root = zip(*rows, strict=True) if rows else [()] * 5
        return self._rows(*(np.array(x, t).view(np.int64) for x, t in ((document, np.int64), (core, np.uint64), (first, np.int64), (n, np.int64), (root, np.int64))))

    def _strings(self, document: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """The strings of blocks; both hashes of each are parts of one."""
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        document, data, digest = np.repeat(document, n), self.bytes, xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(data[x : x + RUN]) for x in at.tolist()]), ">u8").reshape(-1, 2).astype(np.uint64)
        whole = (halves[:, 0] >> np.uint64(64 - WHOLE_OF_STRING)).astype(np.int64)
        return document, np.ascontiguousarray(halves[:, 1]).view(np.int64), whole, at - self.starts[document], np.ones_like(at), np.zeros_like(at)


def _again(*of: np.ndarray) -> np.ndarray:
    """Whether a row's values (document, core, whole) were there before."""
    order = np.lexsort(of)  # stable: equal rows stay in their order
    out = np.zeros(len(order), bool)
    out[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in of])
    return out


def _wanted(own: list[dict]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for x in own:
        out.setdefault(x["root"], set()).add(x["core"])
    return out


def _pieces(texts: DataFrame, kind: int) -> DataFrame:
    """ENTRIES of a kind of texts (own_id, tie, text; beyond the first kind also wanted: root and core)."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for b in steps(batches, "text", STEP_BYTES):
            pieces = Pieces(b.column("text").cast(pa.binary()).to_pylist())
            if kind == 0:
                rows = pieces.entries()
            elif kind == 1:
                rows = pieces.finer([{x["core"]: set() for x in own} for own in b.column("wanted").to_pylist()], False)
            else:
                rows = pieces.finer([_wanted(own) for own in b.column("wanted").to_pylist()], True)
            document, core, whole, at, n, root = rows
            if len(core):
                own_id, tie = (b.column(c).to_numpy()[document] for c in ("own_id", "tie"))
                columns = core, whole, own_id, tie, at.astype(np.int32), n.astype(np.int32), _again(document, core, whole), root
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return texts.mapInArrow(run, ENTRIES)


class Levels:
    """Arrays of one kind: tables (core, whole, own_id, root) sorted and bucketed by core, with one row a core; whole is null
    where several contents were met."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[tuple[str, str, int]] = []  # name, path, batches in it

    def _write(self, rows: DataFrame, batches: int) -> str:
        name, path = f"suffixes_{uuid.uuid4().hex}", scratch_path(self.spark, "level")
        rows.write.bucketBy(self.buckets, "core").sortBy("core").option("path", path).format("parquet").saveAsTable(name)
        self.tables.append((name, path, batches))
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select("core", "whole", "own_id", "root")

    def scan(self, entries: DataFrame) -> DataFrame:
        """The batch's array, scanned against all levels; it is the newest level from now on. core, whole, own_id, root,
        fresh (belongs to the level), n entries, known (stands in an older level), old_id and old_whole (of an entry there
        that stood alone and no longer does), several (contents)."""
        own = entries.groupBy("core").agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.min("own_id").alias("own_id"), F.min("root").alias("root"), F.count(F.lit(1)).alias("n"))
        known, several, mixed = F.lit(False), F.col("low") != F.col("high"), F.lit(False)
        old = F.lit(None).cast("struct<w:bigint,o:bigint>")
        for i, (name, _, _) in enumerate(self.tables):
            level = self._read(name).select("core", F.struct(F.col("whole").alias("w"), F.col("own_id").alias("o")).alias(f"l{i}"))
            own = own.join(level, "core", "left")
            here, whole = F.col(f"l{i}").isNotNull(), F.col(f"l{i}.w")
            known = known | here
            mixed = mixed | (here & whole.isNull())  # several contents were met before
            several = several | (here & (whole.isNull() | (whole != F.col("low"))))
            old = F.coalesce(old, F.when(here & whole.isNotNull(), F.col(f"l{i}")))
        turned = several & ~mixed
        rows = own.select("core", F.when(~several, F.col("low")).alias("whole"), "own_id", "root", "n", (~known | turned).alias("fresh"), known.alias("known"), F.when(turned, old).alias("old"), several.alias("several"))
        rows = rows.select("*", F.col("old.o").alias("old_id"), F.col("old.w").alias("old_whole")).drop("old")
        return self.spark.table(self._write(rows, 1))

    def merge(self) -> None:
        """Merge the newest levels as long as two are of one size."""
        while len(self.tables) > 1 and self.tables[-1][2] == self.tables[-2][2]:
            (a, a_path, n), (b, b_path, m) = self.tables[-2:]
            both = self._read(a).unionByName(self._read(b)).groupBy("core").agg(
                F.when(F.count("whole") == F.count(F.lit(1)), F.min("whole")).alias("whole"), F.min("own_id").alias("own_id"), F.min("root").alias("root"), F.lit(True).alias("fresh"))
            del self.tables[-2:]
            self._write(both, n + m)
            for name, path in ((a, a_path), (b, b_path)):
                self._drop(name, path)

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, path.rpartition("/")[0])

    def close(self) -> None:
        for name, path, _ in self.tables:
            self._drop(name, path)
        self.tables = []


def _few(rows: DataFrame, row_bytes: int) -> DataFrame:
    """Rows of fixed size (8 bytes a column, and 24 in the table they are looked up in), broadcast if they are few in bytes."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


_SPANS = "own_id long, tie long, start int, stop int"


def _joined_spans(rows: DataFrame) -> DataFrame:
    """Spans (own_id, tie, start, stop) of repeats (own_id, tie, at, n); those that follow each other become one before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, tie, at, n = (b.column(c).to_numpy(False) for c in ("own_id", "tie", "at", "n"))
            stop = at + n - 1 + RUN
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > stop[:-1]) | (at[1:] < at[:-1])])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(tie[first]), pa.array(at[first]), pa.array(np.maximum.reduceat(stop, first).astype(np.int32))], ["own_id", "tie", "start", "stop"])

    return rows.select("own_id", "tie", "at", "n").mapInArrow(run, _SPANS)


class Family:
    """The arrays of all kinds, and the spans found so far. ``texts`` (own_id, tie, text) is what the arrays point to."""

    def __init__(self, texts: DataFrame, ties: bool):
        spark = texts.sparkSession
        self.texts, self.ties = texts, ties
        self.kinds = [Levels(spark) for _ in range(3)]
        self.contents = [Levels(spark) for _ in range(2)]  # of cores with several contents, each content
        self.spans: list[DataFrame] = []

    def add(self, batch: Column) -> None:
        """Scan a batch (a condition on own_id; all earlier batches have smaller ids), then make it a level."""
        for levels in (*self.kinds, *self.contents):
            levels.merge()
        texts = self.texts.where(batch)
        for kind in range(3):
            entries = materialize(_pieces(texts, kind), "entries")
            scanned = self.kinds[kind].scan(entries)
            met = scanned.where("n > 1 OR known").select("core", F.col("own_id").alias("first_id"), "known", "several")
            found = entries.join(_few(met, 56), "core")
            repeats = [self._repeats(found.where("NOT several"), "core")]
            if kind == 2:
                self.spans.append(materialize(repeats[0], "spans"))
                break
            mixed = found.where("several").select("core", "whole", "own_id", "tie", "at", "n", "again", "root")
            older = scanned.where("old_id IS NOT NULL").selectExpr("core", "old_whole AS whole", "old_id AS own_id", "0L AS tie", "cast(null AS int) AS at", "0 AS n", "false AS again", "root")
            rows = materialize(mixed.union(older).withColumn("content", F.xxhash64("core", "whole")), "mixed")
            told = self.contents[kind].scan(rows.select(F.col("content").alias("core"), F.col("content").alias("whole"), "own_id", "root"))
            judged = rows.join(_few(told.select(F.col("core").alias("content"), F.col("own_id").alias("first_id"), "known"), 48), "content")
            repeats.append(self._repeats(judged, "content"))
            self.spans.append(materialize(repeats[0].union(repeats[1]), "spans"))
            # The first of each content, and older entries that stood alone until now, are told apart more finely.
            first = judged.where("NOT known AND NOT again AND own_id = first_id")
            wanted = first.groupBy("own_id").agg(F.collect_set(F.struct("root", "core")).alias("wanted"))
            texts = self.texts.join(broadcast_if_few(wanted, "wanted"), "own_id")

    def _repeats(self, rows: DataFrame, key: str) -> DataFrame:
        """Spans of the rows that are not the first of their key: an older level knows it, or an earlier document has it, or an
        earlier place of the same text, or a text that comes earlier under the same doc_id."""
        later = F.col("known") | (F.col("own_id") > F.col("first_id")) | F.col("again")
        spans = _joined_spans(rows.where(later & F.col("at").isNotNull()))
        if self.ties:
            same_id = rows.where(~later & (F.col("tie") != 0)).select(key, "own_id", "tie", "at", "n")
            least = same_id.groupBy(key).agg(F.min("tie").alias("least"))
            spans = spans.union(_joined_spans(same_id.join(least, key).where("tie > least")))
        return spans

    def close(self) -> None:
        for levels in (*self.kinds, *self.contents):
            levels.close()


def _with_ties(docs: DataFrame) -> tuple[DataFrame, bool]:
    """own_id, tie, text: tie is a text's hash where its doc_id has several rows, else 0; and whether there are such."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("own_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = materialize(own.groupBy("own_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own_id", F.lit(True).alias("shared")), "shared")
    if not shared.limit(1).count():
        return own.select("own_id", F.lit(0).cast("long").alias("tie"), "text"), False
    # The lowest bit is set, so that no tie is 0.
    hashed = F.when(F.col("shared"), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    return own.join(broadcast_if_few(shared, "shared"), "own_id", "left").select("own_id", hashed.alias("tie"), "text"), True


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """The texts (own_id, tie, text) and, per text that loses bytes, spans (own_id, tie, spans)."""
    texts, ties = _with_ties(docs)
    cuts = texts.agg(F.percentile_approx("own_id", [i / batches for i in range(1, batches)] or [0.0], 10000)).first()[0] or []
    bounds = sorted({*cuts}) if batches > 1 else []
    family = Family(texts, ties)
    try:
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            inside = F.lit(True)
            if low is not None:
                inside = inside & (F.col("own_id") > low)
            if high is not None:
                inside = inside & (F.col("own_id") <= high)
            family.add(inside)
    finally:
        family.close()
    spans = family.spans[0]
    for more in family.spans[1:]:
        spans = spans.union(more)
    listed = spans.groupBy("own_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("found"))
    return texts, broadcast_if_few(listed.mapInArrow(_merged, "own_id long, tie long, found binary"), "found")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text as maximal ones: starts and stops as 32-bit numbers."""
    for b in batches:
        found = []
        for own in b.column("found").to_pylist():
            gone: list[int] = []
            for s in own:
                if gone and s["start"] <= gone[-1]:
                    gone[-1] = max(gone[-1], s["stop"])
                else:
                    gone += [s["start"], s["stop"]]
            found.append(np.array(gone, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("own_id"), b.column("tie"), pa.array(found, pa.binary())], ["own_id", "tie", "found"])


KEPT = "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, n_bytes, the spans of bytes that go (maximal, in order), and the bytes that stay."""
    texts, spans = repeated_spans(docs, batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(rows, "text"):
            ids, cut, kept, sizes = [], [], [], []
            for own_id, text, found in zip(b.column("own_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("found").to_pylist(), strict=True):
                gone = np.frombuffer(found or b"", np.int32).tolist()
                edges = [0, *gone, len(text)]
                ids.append(None if own_id == -(1 << 63) else own_id)
                sizes.append(len(text))
                cut.append([{"start": a, "stop": z} for a, z in zip(gone[::2], gone[1::2], strict=True)])
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return texts.join(spans, ["own_id", "tie"], "left").select("own_id", "text", "found").mapInArrow(run, KEPT)
