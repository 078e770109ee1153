"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text where its last 32 bytes hash to a fixed pattern, so texts that
share a passage share its chunks whatever stands around it. A Python worker encodes each distinct chunk once and
keeps the ids in a bounded store; other documents (and later batches and tasks of that worker) reuse them.

Encoding chunks apart is wrong only near the joins. The pre-tokenizer never lets a piece run from a visible character
into white space, so a visible ASCII character followed by ASCII white space is a piece border in every context, and
left of one border and right of another the ids of a chunk are those of the whole text. At each join the
stretch between the nearest borders is encoded again and spliced in; where the neighbours' ids do not meet at
the ends of the stretch, it is widened border by border until they agree (at worst to the whole text).

A regular expression with a look-ahead backs up over a run of white space, and gives up on one of about a million characters.
How the pattern splits a run is known, though: all of it but the last character before a visible one is one piece. So runs of
LONG_RUN characters are taken out first and merged as one piece each.

The vocabulary file is the tokenizers library's; in it every id is also the rank of its merge, so a rank-merging
encoder over the same bytes gives the same ids several times faster (the tests hold both against each other).

Defined cases: null text counts as empty; the empty text has no ids; repeated rows each give a row; an empty table gives an empty
table; a text of any length, or with a run of one character of any length, is encoded whole, and a very long one is a step of its own; doc_id of any type that casts to long; other columns are not
read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, steps, texts_of

#: Chunk sizes in bytes: the least, and the most; MASK (high bits, which all 32 bytes reach) gives a cut every 2^7 bytes on average beyond the
#: least, so that a passage of some 50 words holds whole chunks.
LEAST, MOST, MASK = 64, 16384, np.uint32(((1 << 7) - 1) << 25)
#: Bytes of ids and chunks that a worker keeps.
STORE_BYTES = 32 << 20

#: How the byte-level pre-tokenizer splits a text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern means it, in runs; those of so many characters never reach the pattern.
_WHITE, LONG_RUN = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), 50_000

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cuts(data: np.ndarray) -> list[int]:
    """Where the rolling hash cuts these bytes: chunk ends, the last being the length. Always at character borders."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # the hash over 32 bytes, from two halves each time
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, last = [], 0
    marks = np.flatnonzero((h & MASK) == 0) + 1
    for p in [*marks.tolist(), n]:
        while p - last > MOST:
            last = _border(data, last + MOST)
            out.append(last)
        if p == n or p - last >= LEAST:
            q = _border(data, p)
            if q > last:
                out.append(q)
                last = q
    return out


def _border(data: np.ndarray, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def byte_table(tokenizer_path: str) -> tuple[list[bytes], dict[str, int]]:
    """The bytes of each id of a byte-level vocabulary file, and its special tokens."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    char = {chr(b): b for b in plain}
    char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = spec["model"]["vocab"]
    added = {t["id"]: t["content"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*vocab.values(), *added]))
    for token, i in vocab.items():
        out[i] = bytes(char[c] for c in token)
    for i, content in added.items():
        out[i] = content.encode()
    return out, {content: i for i, content in added.items()}


class ChunkCodec:
    """Encodes and decodes texts; keeps ids of chunks seen before."""

    def __init__(self, tokenizer_path: str, store_bytes: int = STORE_BYTES):
        import tiktoken

        self.bytes_of, special = byte_table(tokenizer_path)
        self.special = tuple(special)
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in special.values()}
        self.encoding = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.dtype = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32
        # Two generations: when the younger takes half of the room, it becomes the older, and the older goes.
        self.store: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}
        self.held, self.most = 0, store_bytes // 2
        self.encoded = self.reused = 0

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [self._plain(t) if len(t) < LONG_RUN else self._with_long_runs(t) for t in texts]

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(self.dtype)

    def _with_long_runs(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in _WHITE.finditer(text):
            if m.end() - m.start() < LONG_RUN:
                continue
            # Before a visible character the last one of a run begins the next piece; before the end and a special token it does not.
            end = m.end() if m.end() == len(text) or text.startswith(self.special, m.end()) else m.end() - 1
            out += [self._plain(text[at : m.start()]), np.array(self.encoding._encode_single_piece(text[m.start() : end]), self.dtype)]
            at = end
        return np.concatenate([*out, self._plain(text[at:])])

    def _ids(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk by itself: those not in the store are encoded, each once."""
        own = {c: ids for c in chunks if (ids := self.store.get(c, self.older.get(c))) is not None}
        new = list(dict.fromkeys(c for c in chunks if c not in own))
        own.update(zip(new, self._raw([c.decode() for c in new]), strict=True))
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        out = [own[c] for c in chunks]
        for c, ids in own.items():
            if c not in self.store and self.held <= self.most:
                self.store[c] = ids
                self.held += len(c) + ids.nbytes + 300
        if self.held > self.most:
            self.older, self.store, self.held = self.store, {}, 0
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them for the whole text."""
        blobs, ends, chunks = [t.encode() for t in texts], [], []
        for b in blobs:
            e = cuts(np.frombuffer(b, np.uint8))
            ends.append(e)
            chunks += [b[s:t] for s, t in zip([0, *e], e)]  # noqa: B905
        ids = self._ids(chunks)
        plans, windows, at = [], [], 0
        for b, e in zip(blobs, ends, strict=True):
            own = ids[at : at + len(e)]
            at += len(e)
            if len(e) <= 1:
                plans.append([own[0] if own else np.empty(0, self.dtype)])
                continue
            plan = []
            for piece in self._repair(b, e, own):
                if isinstance(piece, tuple):
                    windows.append(b[piece[0] : piece[1]].decode())
                    plan.append(None)
                else:
                    plan.append(piece)
            plans.append(plan)
        again = iter(self._raw(windows))
        return [np.concatenate([next(again) if x is None else x for x in plan]) if len(plan) > 1 else next(again) if plan[0] is None else plan[0] for plan in plans]

    def _repair(self, blob: bytes, ends: list[int], ids: list[np.ndarray]) -> list:
        """Slices of the chunks' ids and, around the joins, stretches of bytes to encode again."""
        data = np.frombuffer(blob, np.uint8)
        n = len(data)
        safe = np.concatenate([[0], np.flatnonzero(_VISIBLE[data[:-1]] & _SPACE[data[1:]]) + 1, [n]])
        starts = [0, *ends[:-1]]
        marks = [np.concatenate([[s], s + np.cumsum(self.length[x])]) for s, x in zip(starts, ids, strict=True)]
        border = np.concatenate(marks)  # ascending
        windows: list[list[int]] = []
        for p in ends[:-1]:
            i = int(np.searchsorted(safe, p))
            if safe[i] == p:
                continue  # the pieces end here in any context
            left, right = i - 1, i
            while left > 0 and not _has(border, safe[left]):
                left -= 1
            while right < len(safe) - 1 and not _has(border, safe[right]):
                right += 1
            a, z = int(safe[left]), int(safe[right])
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], z)
            else:
                windows.append([a, z])
        out: list = []
        w = 0
        for s, e, x, m in zip(starts, ends, ids, marks, strict=True):
            p = s
            while p < e:
                while w < len(windows) and windows[w][1] <= p:
                    w += 1
                if w < len(windows) and windows[w][0] <= p:
                    if windows[w][0] == p or not out:
                        if not (out and isinstance(out[-1], tuple) and out[-1] == tuple(windows[w])):
                            out.append(tuple(windows[w]))
                    p = min(e, windows[w][1])
                    continue
                q = min(e, windows[w][0]) if w < len(windows) else e
                out.append(x[np.searchsorted(m, p) : np.searchsorted(m, q)])
                p = q
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of decode(ids): the bytes of the ids in order; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


def _has(values: np.ndarray, x: int) -> bool:
    i = int(np.searchsorted(values, x))
    return i < len(values) and values[i] == x


def codec(tokenizer_path: str) -> ChunkCodec:
    """This process's codec of a vocabulary, and its store with it."""
    return kept_in_worker(f"codec {tokenizer_path}", lambda: ChunkCodec(tokenizer_path))


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the ids (array<int>) of every whole text of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in steps(batches, "text"):
            ids = [x.astype(np.int32) for x in own.encode(texts_of(b.column("text")))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), values], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of encode_documents' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in batches:
            texts = [own.decode_bytes(np.array(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: the number of ids, and digests of the ids (unsigned 32-bit, little endian) and of the text decoded
    from them. One pass, no shuffle; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in steps(batches, "text"):
            ids = own.encode(texts_of(b.column("text")))
            columns = [
                b.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
