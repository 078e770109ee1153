"""An index of a corpus that follows its changes.

The tables of the symbol graph are kept as Parquet, in versions. A version holds signed rows: what a set of changed files takes
away (-1) and brings (+1). A table is what its rows sum up to, so a change reads and writes what belongs to its files:

- files, nodes, words, imports: the changed files' own rows, from their contents alone.
- within (a name stands in a symbol's signature) and references (a name stands in a line): the changed files' rows
  against all names, and, where a name is new in the corpus or gone from it, the other files' signatures and words against
  that name. No unchanged file is read again.
- edges follow from within and nodes, since a name may come to belong to another symbol.

A version counts once its marker, one small file that can be created only once, is there; what a failed change wrote is never
read. ``compact`` sums all up into one version.

Defined cases: of several rows of a path one stands (as in CodeCorpus); null content removes a path; a path put in again as it is, or
removed though it is not there, changes nothing; an index without versions is empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..plans.session import cut_lineage
from .graph import CodeCorpus, edges_between, imports, names, names_within, references_in, words_of
from .symbols import extract_symbols, nodes_of

SCHEMAS = {
    "files": "file string, language string, content_hash string",
    "nodes": "symbol_id string, name string, kind string, file string, byte_start long, byte_end long, signature string, pattern_ord int, doc_comment string",
    "words": "file string, line long, byte_offset long, context string, key string",
    "imports": "file string, ord int, target string",
    "within": "from_id string, name string, file string",
    "references": "symbol string, file string, line long, byte_offset long, context_snippet string",
}


class CorpusIndex:
    """The index in a folder of any store that Spark reads. One writer at a time: of two that commit the same version, one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions ---

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _store(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed versions that are read: from the last compacted one on."""
        store, folder = self._store(), self._path("versions")
        if not store.exists(folder):
            return []
        marks = sorted((int(name.split("-")[0]), name.endswith("-base")) for name in (f.getPath().getName() for f in store.listStatus(folder)))
        first = max((v for v, base in marks if base), default=0)
        return [v for v, _ in marks if v >= first]

    def _commit(self, version: int, base: bool) -> None:
        store = self._store()
        # Two kinds of marker, one claim: whoever creates it has the version.
        store.create(self._path("claims", str(version)), False).close()
        out = store.create(self._path("versions", f"{version}-base" if base else f"{version}-delta"), False)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()

    def _signed(self, table: str) -> DataFrame:
        paths = [f"{self.root}/{table}/{v}" for v in self.versions()]
        schema = f"{SCHEMAS[table]}, sign int"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, among: DataFrame | None = None) -> DataFrame:
        """A table's rows; among: only those that join with these rows by the columns they share."""
        rows = self._signed(table)
        columns = [c for c in rows.columns if c != "sign"]
        if among is not None:
            rows = rows.join(among, among.columns, "left_semi")
        return rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    # --- changes ---

    def upsert(self, files: DataFrame) -> None:
        """Put in or replace files(path, language, content); null content removes the path."""
        version = max(self.versions(), default=0) + 1
        last = F.max_by(F.struct("language", "content"), F.struct("language", "content")).alias("f")
        asked = files.groupBy(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).agg(last).select("path", "f.language", "f.content")
        old = self.read("files", asked.select(F.col("path").alias("file")).distinct()).select(F.col("file").alias("path"), F.col("language").alias("was"), F.col("content_hash").alias("hash"))
        same = F.col("language").eqNullSafe(F.col("was")) & content_hash(F.col("content")).eqNullSafe(F.col("hash")) & F.col("hash").isNotNull()
        known = asked.join(old, "path", "left").withColumn("known", F.col("hash").isNotNull())
        changed = cut_lineage(known.where(~same & (F.col("content").isNotNull() | F.col("known"))).select("path", "language", "content"))
        if changed.isEmpty():
            return
        gone, new = changed.select(F.col("path").alias("file")), changed.where("content IS NOT NULL")
        brought = {
            "files": new.select(F.col("path").alias("file"), "language", content_hash(F.col("content")).alias("content_hash")),
            "nodes": nodes_of(extract_symbols(new, with_docs=True)),
            "words": words_of(new),
            "imports": imports(new),
        }
        own = {t: self._put(version, t, self.read(t, gone), rows) for t, rows in brought.items()}
        # Names that come to be, and names that no symbol has any more.
        touched = own["nodes"].select("name").distinct()
        before = self.read("nodes", touched)
        kept = before.join(gone, "file", "left_anti").select("name").distinct()
        now = own["nodes"].where("sign > 0").select("name").union(kept).distinct()
        had = before.select("name").distinct()
        born = cut_lineage(now.join(had, "name", "left_anti"))
        dead = cut_lineage(had.join(now, "name", "left_anti"))
        every = self.read("nodes").select("name").distinct().join(dead, "name", "left_anti").union(born)
        nodes = own["nodes"].where("sign > 0")
        found = names_within(nodes, every).join(nodes.select(F.col("symbol_id").alias("from_id"), "file"), "from_id")
        others = self.read("nodes").join(gone, "file", "left_anti")
        found = found.union(names_within(others, born).join(others.select(F.col("symbol_id").alias("from_id"), "file"), "from_id"))
        lost = self.read("within", gone).union(self.read("within", dead).join(gone, "file", "left_anti").select("from_id", "name", "file"))
        self._put(version, "within", lost, found.select("from_id", "name", "file"))
        said = references_in(own["words"].where("sign > 0").drop("sign"), every)
        key = F.regexp_extract("name", r"[A-Za-z0-9_]+", 0)
        keys = born.select(F.when(key == "", "$").otherwise(key).alias("key")).distinct()
        said = said.union(references_in(self.read("words", keys).join(gone, "file", "left_anti").select("file", "line", "byte_offset", "context", "key"), born))
        lost = self.read("references", gone).union(self.read("references", dead.withColumnRenamed("name", "symbol")).join(gone, "file", "left_anti").select("symbol", "file", "line", "byte_offset", "context_snippet"))
        self._put(version, "references", lost, said)
        self._commit(version, False)

    def _put(self, version: int, table: str, lost: DataFrame, found: DataFrame) -> DataFrame:
        """Write a version's rows of a table, and read them again."""
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        rows = lost.select(*columns).withColumn("sign", F.lit(-1)).union(found.select(*columns).withColumn("sign", F.lit(1)))
        rows.write.mode("overwrite").parquet(path := f"{self.root}/{table}/{version}")  # a failed change may have left some
        return self.spark.read.schema(f"{SCHEMAS[table]}, sign int").parquet(path)

    def remove(self, paths: DataFrame) -> None:
        """Take files(path) out."""
        self.upsert(paths.select("path", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("content")))

    def compact(self) -> None:
        """Sum all versions up into one. Older ones stay for readers that have begun, and are no longer read."""
        if len(self.versions()) > 1:
            version = max(self.versions()) + 1
            for table in SCHEMAS:
                self._put(version, table, self.read(table).limit(0), self.read(table))
            self._commit(version, True)

    # --- tables ---

    def edges(self) -> DataFrame:
        return edges_between(self.read("within").select("from_id", "name"), names(self.read("nodes")))

    def corpus(self) -> CodeCorpus:
        """The index as a corpus: impact, links, cycles, orphans and health from its tables, no content read."""
        files = self.read("files").select(F.col("file").alias("path"), "language", F.lit(None).cast("string").alias("content"))
        out = CodeCorpus(files)
        made = {"nodes": self.read("nodes"), "edges": self.edges(), "references": self.read("references"), "imports": self.read("imports")}
        out._made.update({k: v.persist() for k, v in made.items()})
        return out
