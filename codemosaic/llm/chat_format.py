"""Chat formatting by columnar byte assembly.

Turns are dealt out by ranges of their order and sorted; each Arrow batch is then assembled at once: numpy computes the length
of every segment (header, escaped text, end mark), their cumulative offsets and the scatter indices, and copies all
bytes into one preallocated buffer that becomes the Arrow string column. Roles are encoded as a dictionary, so only distinct
ones are looked at one by one.

Template: ``<turn ROLE>`` line end TEXT ``</turn>`` line end. In texts a backslash stands before each backslash and
``<``, in roles also before ``>``; so marks cannot be forged and every text can be had back exactly.

A conversation may be of any length, and one that holds much of the table is formatted by many tasks: it comes out as
parts of bounded size, whose texts in the order of ``part`` are the conversation. ``loss`` holds the spans (start, end; code
points within the part) of assistant texts, escaped as they stand.

``read_back`` digests conversations where their parts lie together; only those at the borders of a partition, or of more
than HELD bytes, are dealt out once more. A digest of all turns is one sequential hash, so at the end one task reads a
conversation's parts, one after the other, never holding it whole.

Defined cases: null text, role: empty; rows that tie on conv_id and turn follow by role and text; null conv_id is a
conversation of its own, null turn comes first; repeated rows are repeated turns; an empty table gives an empty table; a very long
text is a part by itself; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps

SCHEMA = "conv_id long, part long, n_turns int, formatted string, loss array<struct<start:int,end:int>>"
#: Characters of a text that decide, with the columns before it, where a range ends; and bytes of a conversation's parts that are held at once.
PREFIX, HELD = 64, 8 << 20
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_TURN = re.compile(r"<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape_role(role: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", role)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, and where each row starts and how long it is; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    return data, at[:-1], np.diff(at)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all segments, where each segment starts (and the last ends), and where its text starts and ends."""
    roles = roles.fill_null("").dictionary_encode()
    heads = [f"<turn {escape_role(r)}>\n".encode() for r in roles.dictionary.to_pylist()]
    table = np.frombuffer(b"".join(heads), np.uint8)
    sizes = np.array([len(x) for x in heads], np.int64)
    which = roles.indices.to_numpy()
    head_at, head_n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    data, at, n = _utf8(texts)
    source = np.repeat(at, n) + _ramp(n)
    chars = data[source]
    marked = (chars == 0x5C) | (chars == 0x3C)
    before = np.concatenate([[0], np.cumsum(marked)])
    ends = np.cumsum(n)
    text_n = n + before[ends] - before[ends - n]
    tail = np.frombuffer(b"</turn>\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(head_n + text_n + len(tail))])
    out = np.empty(starts[-1], np.uint8)
    out[np.repeat(starts[:-1], head_n) + _ramp(head_n)] = table[np.repeat(head_at, head_n) + _ramp(head_n)]
    text_at = starts[:-1] + head_n
    target = np.repeat(text_at - before[ends - n], n) + _ramp(n) + before[1:]
    out[target] = chars
    out[target[marked] - 1] = 0x5C
    out[(starts[1:, None] - len(tail)) + np.arange(len(tail))] = tail
    return out, starts, text_at, text_at + text_n


def format_conversations(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as formatted parts (SCHEMA); one shuffle, by ranges of the order of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32  # ranges are in order, and parts within them
        for b in steps(batches, "text"):
            ids = b.column("conv_id")
            known, value = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (known[1:] != known[:-1])]))
            stop = np.append(first[1:], len(ids))
            out, starts, text_at, text_end = assemble(b.column("role"), b.column("text"))
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(starts[np.append(first, len(ids))].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            said = np.flatnonzero(pa.compute.equal(b.column("role"), "assistant").fill_null(False).to_numpy(False))
            zero = points[starts[np.repeat(first, stop - first)]][said]
            spans = pa.StructArray.from_arrays([pa.array(points[x[said]] - zero, pa.int32()) for x in (text_at, text_end)], ["start", "end"])
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(said, np.append(first, len(ids))), pa.int32()), spans)
            columns = [ids.take(pa.array(first)), pa.array(part + np.arange(len(first)), pa.int64()), pa.array(stop - first, pa.int32()), formatted, loss]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "formatted", "loss"])
            part += len(first)

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # The ends of ranges are samples of these keys, so they hold no whole texts; rows equal in all of them stay together.
    ranged = kept.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return out


class _Digest:
    """What DIGESTS says of a conversation, fed part by part."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.all = 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in parse(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for s in spans:
            masked = unescape(text[s["start"] : s["end"]])
            self.chars += len(masked)
            self.loss.update(masked.encode())
        self.all += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.all


_NAMES = [c.split()[0] for c in DIGESTS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_PART = [("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for s in steps(iter([b]), "formatted"):
            yield from zip(*(s.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*_KINDS, *(k for _, k in _PART)][: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_NAMES, *(n for n, _ in _PART)][: len(rows[0])])


def _gathered(rows: Iterator[tuple], most: int = HELD, count: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[7] or "") if len(r) > 7 else 0
        if size > most or len(held) >= count:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _digested(conversation: list[tuple]) -> tuple:
    d = _Digest(conversation[0][0])
    for _, _, text, spans in conversation:
        d.add(text, spans)
    return (*d.row(), None, None, None)


def _passed_on(conversation: list[tuple]) -> list[tuple]:
    return [(conv_id, None, None, None, None, None, part, text, spans) for conv_id, part, text, spans in conversation]


def read_back(formatted: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """Digests (DIGESTS) of what format_conversations wrote, read from it again."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of conversations that lie wholly within the partition; the parts of others as they are."""

        def rows() -> Iterator[tuple]:
            own: list[tuple] = []
            size, inner, started = 0, False, False  # inner: another conversation came before this one
            for p in _parts(batches):
                if started and p[0] != now:
                    if own:
                        yield from [_digested(own)] if inner and size <= held_bytes else _passed_on(own)
                    own, size, inner = [], 0, True
                now, started = p[0], True
                own.append(p)
                size += len(p[2])
                if size > held_bytes or not inner:
                    yield from _passed_on(own)
                    own = []
            yield from _passed_on(own)  # it may go on in the next partition

        yield from _gathered(rows())

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now = None
            for conv_id, _, text, spans in _parts(batches):
                if now is not None and conv_id != now.conv_id:
                    yield now.row()
                    now = None
                now = now or _Digest(conv_id)
                now.add(text, spans)
            if now:
                yield now.row()

        yield from _gathered(rows())

    first = materialize(formatted.select("conv_id", "part", "formatted", "loss").mapInArrow(near, f"{DIGESTS}, part long, formatted string, loss array<struct<start:int,end:int>>"), "near")
    split = first.where("part IS NOT NULL").select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return first.where("part IS NULL").select(*_NAMES).union(split.mapInArrow(far, DIGESTS))
