"""Token counts as delta-maintained rollups.

A store holds, per committed batch, signed deltas of documents and tokens by source, language and tokenizer version. An insert
adds its count, a delete takes it away, a revision adds the difference of the new count and the old one; totals are
sums of deltas, so no batch ever reads documents that were counted before.

A batch is committed by renaming its finished folder to a name made from its id: it is there whole or not at all, and
an id that is there already is refused, so a batch may be sent again after any failure. ``compact`` folds committed
deltas into one base that remembers their ids.

Every reader lists the store once, deltas before base, and reads exactly what it listed, leaving out deltas that the base
holds: a batch is so counted once, whichever commits and compactions run meanwhile. A compaction removes only what the base
before its own had folded already, so folders that a reader has just listed stay until the compaction after the next; a
reader that takes longer lists anew (``read``).

Layout below the store's path (in a store all executors share): ``deltas/<digest>``, ``base/<number>``, ``staging``.

Defined cases: null counts are 0; null source, language or version is a group of its own; groups whose documents and tokens
are all 0 are not in the totals; repeated rows of a batch each count; an empty batch commits and changes nothing, an empty
store has no totals; a very long text counts whole; an unknown operation fails the batch, which then is not committed; other
columns of a feed are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_chunks import codec
from .common import steps, texts_of

R = TypeVar("R")

KEYS = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Deltas (DELTAS, one row a group) of changes(op, source, lang, tokenizer_version, n_tokens, old_n_tokens).
    Rows are summed before they are dealt out, so a source with most of the rows is no burden."""
    now, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    docs = F.coalesce(docs.cast("long"), F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("long"))
    tokens = F.when(op == "insert", now).when(op == "delete", -now).otherwise(now - old)
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class RollupStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _put(self, staged: str, final: str) -> bool:
        """Rename a finished folder; False if the name is taken."""
        at = self._hadoop(final)
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(self._hadoop(staged), at):
            return False
        inside = self._hadoop(f"{final}/{staged.rpartition('/')[2]}")
        if self._fs.exists(inside):  # another writer was faster, and rename moved the folder into its
            self._fs.delete(inside, True)
            return False
        return True

    @staticmethod
    def digest(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()

    def _bases(self) -> list[int]:
        return sorted(int(n) for n in self._names("base") if n.isdigit())

    def _held(self, base: int | None) -> DataFrame:
        """The digests (batch) of the batches that a base has folded."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/base/{base}/batches") if base else self.spark.createDataFrame([], "batch string")

    def _state(self) -> tuple[list[str], int | None]:
        """The deltas that no base holds, and the newest base. Deltas are listed first: one that is folded meanwhile is then
        found in the base, and one that is committed meanwhile is in neither."""
        names, bases = self._names("deltas"), self._bases()
        base = bases[-1] if bases else None
        held = {r[0] for r in self._held(base).where(F.col("batch").isin(names)).collect()} if names and base else set()
        return [n for n in names if n not in held], base

    def is_committed(self, batch_id: str) -> bool:
        name = self.digest(batch_id)
        if self._fs.exists(self._hadoop(f"{self.path}/deltas/{name}")):
            return True
        bases = self._bases()
        return bool(bases) and not self._held(bases[-1]).where(F.col("batch") == name).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False, without reading them, if this id is committed already."""
        if self.is_committed(batch_id):
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        signed(changes).write.parquet(staged)  # a row a group
        done = not self.is_committed(batch_id) and self._put(staged, f"{self.path}/deltas/{self.digest(batch_id)}")
        if not done:
            self._fs.delete(self._hadoop(staged), True)
        return done

    def _sums(self, names: list[str], base: int | None) -> DataFrame:
        paths = [f"{self.path}/deltas/{n}" for n in names] + ([f"{self.path}/base/{base}/totals"] if base else [])
        deltas = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, of what is committed now."""
        return self._sums(*self._state())

    def read(self, use: Callable[[DataFrame], R], tries: int = 3) -> R:
        """use(totals()), done again from a new listing if two compactions have meanwhile removed what it read."""
        for left in range(tries - 1, -1, -1):
            before = self._bases()
            try:
                return use(self.totals())
            except Exception:
                if not left or self._bases() == before:
                    raise

    def compact(self) -> bool:
        """Fold the committed deltas into a new base, and remove what the one before it had folded; False if another compaction
        was faster."""
        names, base = self._state()
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self._sums(names, base).write.parquet(f"{staged}/totals")
        folded = self.spark.createDataFrame([(n,) for n in names], "batch string")
        self._held(base).unionByName(folded).write.parquet(f"{staged}/batches")
        if not self._put(staged, f"{self.path}/base/{(base or 0) + 1}"):
            self._fs.delete(self._hadoop(staged), True)
            return False
        if base:
            others = sorted({*self._names("deltas")} - {*names})  # committed meanwhile, or folded by the base before
            gone = [f"deltas/{r[0]}" for r in self._held(base).where(F.col("batch").isin(others)).collect()] if others else []
            for path in [*gone, *(f"base/{old}" for old in self._bases() if old < base)]:
                self._fs.delete(self._hadoop(f"{self.path}/{path}"), True)
        return True


COUNTED = "source string, lang string, bpe long, words long"


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document of docs(source, lang, text): source, lang, its BPE tokens and its white-space words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for b in steps(batches, "text"):
            texts = texts_of(b.column("text"))
            bpe, words = [len(x) for x in own.encode(texts)], [len(t.encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("lang"), pa.array(bpe, pa.int64()), pa.array(words, pa.int64())], [c.split()[0] for c in COUNTED.split(", ")])

    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, COUNTED)


def changes(counted: DataFrame, op: str, version: str, now: str | None, old: str | None = None) -> DataFrame:
    """A batch: one operation for every document of count_tokens, its counts taken from these columns."""
    number = lambda c: F.col(c).cast("long") if c else F.lit(None).cast("long")
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), number(now).alias("n_tokens"), number(old).alias("old_n_tokens"))
