"""Streams of code: checks as files arrive, and a cache whose entries are streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import content_hash
from ..operators.cache import Lru
from ..operators.guard import verify

FILES = "path string, language string, content string"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of FILES in a folder, as they come."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def verified_stream(files: DataFrame) -> DataFrame:
    """path, passed, violation, detail of each file of a stream; stateless."""
    return verify(files.select("path", "content")).drop("content")


def start(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to a folder, each row once."""
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


STATE = "keys array<string>"
CACHE_LOG = "cache_id string, seq long, content_hash string, hit boolean, evicted string, n_entries int"


def cache_stream(ops: DataFrame, most: int) -> DataFrame:
    """What each of a stream of ops(cache_id, seq, op, content) did (CACHE_LOG); a cache's keys, at most ``most``, are its state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = Lru(most)
        if state.exists:
            cache.entries = dict.fromkeys(state.get[0])
        for rows in sorted(parts, key=lambda p: p["seq"].min()):
            out = []
            for r in rows.sort_values("seq").itertuples():
                hit, evicted = (cache.get(r.content_hash), None) if r.op == "get" else (None, cache.insert(r.content_hash))
                out.append((key[0], r.seq, r.content_hash, hit, evicted, len(cache.entries)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CACHE_LOG.split(", ")])
        state.update((list(cache.entries),))

    keyed = ops.select("cache_id", F.col("seq").cast("long").alias("seq"), "op", content_hash(F.col("content")).alias("content_hash"))
    return keyed.groupBy("cache_id").applyInPandasWithState(step, CACHE_LOG, STATE, "append", GroupStateTimeout.NoTimeout)
