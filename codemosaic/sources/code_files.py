"""Source trees as DataFrames of files(path, language, content, n_bytes, content_hash), and files written back.

Spark's own folder readers pass over names that begin with an underscore (``__init__.py``), so the driver lists paths and
the executors read them. Trees must be on storage that all machines mount; corpora at scale are better kept as
Parquet, which ``from_parquet`` loads.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.languages import UNKNOWN, extension_of, language_named, language_of

#: Names of files and folders that are passed over, as are all that begin with a dot (fixed values).
SKIPPED = ("target", "node_modules", "dist", "build")
FILES_PER_PARTITION = 256


def kept_name(name: str) -> bool:
    return not name.startswith(".") and name not in SKIPPED


def list_files(root: str) -> list[str]:
    """Paths of the tree's source files, relative to its root, with slashes; folders that cannot be read are passed over."""
    out = []
    for top, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if kept_name(f))
        for name in sorted(files):
            if kept_name(name) and language_named(os.path.splitext(name)[1][1:]) != UNKNOWN:
                out.append(os.path.relpath(os.path.join(top, name), root).replace("\\", "/"))
    return out


def _with_language(files: DataFrame) -> DataFrame:
    content = F.col("content")
    return files.select("path", language_of(extension_of(F.col("path"))).alias("language"), "content", F.octet_length(content).cast("long").alias("n_bytes"), content_hash(content).alias("content_hash"))


def from_directory(spark: SparkSession, root: str) -> DataFrame:
    """All source files below a folder; files that cannot be read or are no UTF-8 are passed over."""
    paths = list_files(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // FILES_PER_PARTITION))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for path in b.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        kept.append((path, f.read().decode()))
                except (OSError, UnicodeDecodeError):
                    continue
                if len(kept) >= 64:
                    yield _batch(kept)
                    kept = []
            if kept:
                yield _batch(kept)

    return _with_language(listed.mapInArrow(read, "path string, content string"))


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    path, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.string())], ["path", "content"])


def from_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Source files of any store that Spark reads (names that begin with an underscore apart), pruned by path before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").load(path)
    root = path.rstrip("/")
    relative = F.replace(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), F.lit("^\\Q" + root.split(":")[-1].rstrip("/") + "\\E/?"), F.lit("")), F.lit("\\"), F.lit("/"))
    found = found.select(relative.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    names = "|".join(SKIPPED)
    return _with_language(found.where(~F.col("path").rlike(rf"(^|/)(\.[^/]*|{names})(/|$)") & F.col("content").isNotNull())).where(F.col("language") != UNKNOWN)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Files kept by ``write_parquet``; a filter on language reads the partitions of that language only."""
    return spark.read.parquet(path)


def write_parquet(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").partitionBy("language").parquet(path)


def write_text(path: str, text: str) -> None:
    """Put a text in a file's place: written beside it first, then renamed."""
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", dir=os.path.dirname(os.path.abspath(path)), delete=False) as f:
        f.write(text)
    if os.path.exists(path):
        os.chmod(f.name, os.stat(path).st_mode)
    os.replace(f.name, path)
