"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a Python operator holds at once (a longer text is a step of its own).
STEP_BYTES = 4 << 20

R = TypeVar("R")

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path is opened by Spark alone, so any store that Spark reads will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches between the JVM and Python of STEP_BYTES at most (or one row), where the session has Spark's own default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, f"{STEP_BYTES}b")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of our own if this one machine is all
    there is; on a cluster, where executors would each write to their own disk, an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(checkpoint_root, "own", None) or tempfile.mkdtemp(prefix="checkpoints-")
        checkpoint_root.own = root
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


atexit.register(_drop_scratch)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, removed when the application ends."""
    bound_batches(spark)
    path = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}/{name}"
    _scratch.append((spark, path.rpartition("/")[0]))
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that are written to the shared folder within are removed at the end: what is to be kept has its path from before."""
    before = len(_scratch)
    try:
        yield
    finally:
        own = _scratch[before:]
        del _scratch[before:]
        for spark, path in own:
            delete_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs nothing twice."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows, as executors hold them, that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _row_bytes(schema: T.StructType) -> Column:
    """An upper bound of the bytes that a row takes in memory: 16 and 8 a column, and what strings and arrays hold."""
    size = F.lit(16 + 8 * len(schema.fields))
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.greatest(F.size(F.col(f.name)), F.lit(0)) * (16 + (8 * len(f.dataType.elementType.fields) if isinstance(f.dataType.elementType, T.StructType) else 0)) + 24
        elif isinstance(f.dataType, T.StructType):
            size = size + 16 + 8 * len(f.dataType.fields)
    return size


def broadcast_if_few(rows: DataFrame, name: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """A narrow table, written; broadcast to what it is joined with if the bytes of its rows, which are summed, are few.
    Which of the two joins runs changes no result."""
    written = materialize(rows, name)
    return F.broadcast(written) if (written.agg(F.sum(_row_bytes(written.schema))).first()[0] or 0) <= most else written


def smallest_by_hash(rows: DataFrame, n: int, key: str, *ties: str | Column) -> DataFrame:
    """The n rows with the smallest hashes of a key. Only rows below a hash that about 4 n rows are below are sorted, so what
    partitions send on is bounded by n, not by how many partitions there are."""
    of = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = 4 * n / max(1, rows.count())
    few = rows if share >= 1 else rows.where(of < int(share * (1 << 30)))
    return few.orderBy(of, key, *ties).limit(n)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo n; null counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def crc_of(value: object) -> int:
    """What crc_mod hashes, in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column's texts, with null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most so many bytes of text (or one row) and so many rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    release()


_kept: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free within this process back to the system: other workers and the JVM share the machine's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def kept_in_worker(name: str, make: Callable[[], R]) -> R:
    """This Python worker's own object of an operator. Workers serve one operator after another, so only the last one's is
    kept."""
    if name not in _kept:
        _kept.clear()
        release()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """What kept_in_worker keeps is not needed by the operator that now runs."""
    if _kept:
        _kept.clear()
        release()
