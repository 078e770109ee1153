"""Content-hash caches with least-recently-used eviction, as state over an ordered log of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash

DEFAULT_ENTRIES = 1024

LOG = "cache_id string, seq long, op string, content_hash string, hit boolean, evicted string, n_entries int, skeleton string, n_symbols int"


class Lru:
    """The entries of one cache and what each holds, the least recently used first."""

    def __init__(self, most: int):
        self.most = max(1, most)
        self.entries: dict[str, object] = {}

    def get(self, key: str) -> bool:
        if key not in self.entries:
            return False
        self.entries[key] = self.entries.pop(key)
        return True

    def insert(self, key: str, value: object = None) -> str | None:
        """Put a key with what it holds in; a full cache first loses its least recently used entry, even if the key is there already."""
        evicted = None
        if len(self.entries) >= self.most:
            evicted = next(iter(self.entries))
            del self.entries[evicted]
        self.entries.pop(key, None)
        self.entries[key] = value
        return evicted


def replay(ops: DataFrame, most: int = DEFAULT_ENTRIES) -> DataFrame:
    """What each of ops(cache_id, seq, op, content) did (LOG), op being insert or get. An insert stores the skeleton and the
    number of symbols that its row has (null without such columns); a get that hits has them back.

    Rows are dealt out by cache and sorted; a task holds the entries of one cache at a time, at most ``most``, however long its
    log is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache = object(), Lru(most)
        for b in batches:
            rows = []
            for cache_id, seq, op, key, *value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cache_id != now:
                    now, cache = cache_id, Lru(most)
                hit, evicted = (cache.get(key), None) if op == "get" else (None, cache.insert(key, value))
                rows.append((cache_id, seq, op, key, hit, evicted, len(cache.entries), *(cache.entries[key] if hit else (None, None))))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LOG.split(", ")])

    held = [(F.col(c) if c in ops.columns else F.lit(None)).cast(t).alias(c) for c, t in (("skeleton", "string"), ("n_symbols", "int"))]
    keyed = ops.select(F.col("cache_id").cast("string").alias("cache_id"), F.col("seq").cast("long").alias("seq"), "op", content_hash(F.col("content")).alias("content_hash"), *held)
    return keyed.repartition("cache_id").sortWithinPartitions("cache_id", "seq").mapInArrow(run, LOG)


def dedupe_contents(files: DataFrame) -> DataFrame:
    """content_hash, n_files, first_path of each distinct content."""
    return files.groupBy(content_hash(F.col("content")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))
