"""Queries of the code-corpus operators over synthetic corpora and the driver's tables, each with its SQL where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64_column
from ..functions.languages import is_frontend, language_of
from ..operators import cache, contracts, guard, rewrite
from ..operators.graph import CodeCorpus
from ..operators.index import CorpusIndex
from ..operators.symbols import display_kind, extract_symbols, imports, nodes_of, resolved, rollup_by_kind
from .corpora import GUARD_MIX, INTENTS, POLY, RING_TS, SVC_RUST, corpus
from .session import shared_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- guard ---


def _one_pass(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = corpus(spark, sf_dir, "guard_mix").select("path", make(F.col("content")).alias("detail"))
        return found.where("detail IS NOT NULL").select("path")

    return run


_WORD, _FN = "[a-zA-Z_][a-zA-Z0-9_]*", "contains(content, 'fn ') OR contains(content, 'impl ') OR contains(content, 'pub struct ') OR contains(content, 'pub enum ')"
_PASS_SQL = {
    "guard_div": (guard.division, rf"regexp_matches(content, '{_WORD}\s*/\s*{_WORD}') AND NOT regexp_matches(content, '/\s*[0-9]+(\.[0-9]+)?') AND NOT contains(content, '!= 0') AND NOT contains(content, 'assert!')"),
    "guard_array": (guard.array_bounds, rf"regexp_matches(content, '{_WORD}\s*\[\s*{_WORD}\s*\]') AND NOT regexp_matches(content, '\.len\(\)|\.get\s*\(|\.is_empty\(\)|assert!\s*\(')"),
    "guard_mutex": (guard.async_mutex, r"contains(content, 'sync::Mutex') AND contains(content, '.await')"),
    "guard_hooks": (guard.conditional_hooks, rf"NOT ({_FN} OR contains(content, 'use std::')) AND regexp_matches(content, '(?s)\bif\s*\([^)]*\)\s*\{{[^}}]*\buse[A-Z][a-zA-Z0-9_]*\s*\(')"),
    "guard_secret": (guard.client_secret, rf"NOT ({_FN} OR contains(content, 'use std::')) AND contains(content, '\"use client\"') AND regexp_matches(content, 'process\.env\.[A-Z0-9_]+') AND NOT contains(content, 'env.NEXT_PUBLIC_')".replace('\\"', '"')),
    "guard_html": (guard.inner_html, rf"NOT ({_FN} OR contains(content, 'use std::')) AND regexp_matches(content, 'dangerouslySetInnerHTML\s*=\s*\{{\{{\s*__html\s*:\s*[^}}]+\}}\}}') AND NOT contains(content, 'sanitize')"),
}
for _name, (_make, _where) in _PASS_SQL.items():
    _QUERIES[_name] = _one_pass(_make)
    _SQL[_name] = f"SELECT path FROM ({GUARD_MIX}) WHERE {_where}"


def _scanned(field: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scanned = corpus(spark, sf_dir, "guard_mix").select("path", guard.scan(F.col("content")).alias("s"))
        return scanned.where(F.col(f"s.{field}").isNotNull()).select("path")

    return run


for _name, _field, _where in (
    ("guard_unwrap", "unwrap", r"regexp_matches(content, '\.(unwrap|expect)\s*\(')"),
    ("guard_redos", "redos", "contains(content, '(a+)+')"),
    ("guard_null", "deref", rf"NOT ({_FN}) AND regexp_matches(content, '[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$]') AND contains(content, 'export ') AND NOT contains(content, '?.')"),
    ("guard_jsx", "tags", "contains(content, '<span></div>')"),
):
    _QUERIES[_name] = _scanned(_field)
    _SQL[_name] = f"SELECT path FROM ({GUARD_MIX}) WHERE {_where}"


@_query(f"SELECT path, CAST(len(regexp_extract_all(content, '[(\\[{{]')) = len(regexp_extract_all(content, '[)\\]}}]')) AS BOOLEAN) AS balanced FROM ({GUARD_MIX})")
def guard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "guard_mix").select("path", guard.scan(F.col("content")).getField("balanced").alias("balanced"))


@_query(
    f"""SELECT CASE p_partkey % 13 WHEN 1 THEN 'DIV_BY_ZERO' WHEN 2 THEN 'ARRAY_OOB' WHEN 3 THEN 'UNSAFE_UNWRAP' WHEN 4 THEN 'ASYNC_MUTEX_DEADLOCK' WHEN 5 THEN 'CONDITIONAL_HOOK_CALL'
    WHEN 6 THEN 'CLIENT_SECRET_LEAK' WHEN 7 THEN 'UNSAFE_INNER_HTML' WHEN 8 THEN 'NULL_DEREF' WHEN 9 THEN 'UNBALANCED_DELIMITERS' WHEN 10 THEN 'REDOS_PATTERN' WHEN 11 THEN 'JSX_TAG_MISMATCH'
    ELSE 'none' END AS violation, count(*) AS n_files FROM part GROUP BY 1"""
)
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.violation_histogram(guard.verify(corpus(spark, sf_dir, "guard_mix")))


@_query()
def guard_pages_jsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", guard.scan(F.col("html")).alias("s"))
    return pages.select("page_id", F.col("s.balanced").alias("balanced"), F.col("s.tags").alias("tags"))


# --- symbols ---


def _symbols(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract_symbols(corpus(spark, sf_dir, "poly").where(F.col("language") == language))
        return found.select("name", "kind", display_kind(F.col("kind")).alias("display"), "file", "byte_start", "byte_end", "signature")

    return run


_K = "CAST(s_suppkey AS STRING)"

#: Of each declaration of the poly corpus: name, kind, how that is shown, where its text begins, behind which text it ends (null: with
#: the file), signature.
_DECLARED = """
SELECT {name} AS name, {kind} AS kind, {display} AS display, path AS file, CAST(instr(content, {begins}) - 1 AS BIGINT) AS byte_start,
  CAST(coalesce(instr(content, {begins}) - 1 + instr(substr(content, instr(content, {begins})), {ends}) - 1 + {kept}, length(content)) AS BIGINT) AS byte_end, {signature} AS signature
FROM (SELECT regexp_extract(path, '_([0-9]+)', 1) AS k, path, content FROM ({corpus}) WHERE language = {language})
"""


def _declared(language: str, *rows: tuple[str, str, str, str, str, int, str]) -> str:
    names = ("name", "kind", "display", "begins", "ends", "kept", "signature")
    return " UNION ALL ".join(_DECLARED.format(corpus=POLY, language=f"'{language}'", **dict(zip(names, row, strict=True))) for row in rows)


_RS = _declared(
    "rust",
    ("concat('Item', k)", "'Struct'", "'struct'", "'pub struct'", "'}'", 1, "concat('pub struct Item', k)"),
    ("concat('Kind', k)", "'Enum'", "'enum'", "'pub enum'", "'}'", 1, "concat('pub enum Kind', k)"),
    ("concat('load', k)", "'Function'", "'fn'", "'pub async'", "'}'", 1, "concat('pub async fn load', k, '(k: Kind', k, ')')"),
)
_TS = _declared(
    "typescript",
    ("concat('Row', k)", "'Trait'", "'trait'", "'export interface'", "'}'", 1, "concat('export interface Row', k)"),
    ("concat('fetch', k)", "'Function'", "'fn'", "'export function'", "'}'", 1, "concat('export function fetch', k, '(r: Row', k, ')')"),
    ("concat('pick', k)", "'Function'", "'fn'", "'export const'", "';'", 1, "concat('export const pick', k, ' = (x) => x')"),
)
_PY = _declared(
    "python",
    ("concat('Box', k)", "'Struct'", "'struct'", "'class Box'", "concat(chr(10), 'def open')", 0, "concat('class Box', k)"),
    ("concat('open', k)", "'Function'", "'fn'", "'def open'", "NULL", 0, "concat('def open', k, '(b)')"),
)
for _name, _language, _text in (("symbols_rust", "rust", _RS), ("symbols_ts", "typescript", _TS), ("symbols_py", "python", _PY)):
    _QUERIES[_name] = _symbols(_language)
    _SQL[_name] = _text


@_query(
    f"""SELECT concat('lib/a', {_K}, '.ts') AS file, CAST(0 AS INT) AS ord, concat('lib/./b', {_K}) AS target FROM supplier UNION ALL SELECT concat('lib/a', {_K}, '.ts'), 1, concat('lib/../c', {_K}) FROM supplier
    UNION ALL SELECT concat('use/u', {_K}, '.ts'), 0, concat('a', {_K}, '.ts') FROM supplier UNION ALL SELECT concat('use/u', {_K}, '.ts'), 1, concat('far/lib/a', {_K}, '.ts') FROM supplier
    UNION ALL SELECT concat('py/p', {_K}, '.py'), 0, 'os' FROM supplier UNION ALL SELECT concat('py/p', {_K}, '.py'), 1, concat('pkg.mod', {_K}) FROM supplier"""
)
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(corpus(spark, sf_dir, "lib_mix"))


@_query(f"SELECT concat('use/u', {_K}, '.ts') AS file, CAST(i AS INT) AS ord, concat('lib/a', {_K}, '.ts') AS target_file FROM supplier, (SELECT unnest([0, 1]) AS i)")
def suffix_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeCorpus(corpus(spark, sf_dir, "lib_mix")).import_links().select("file", "ord", "target_file")


@_query(
    f"""SELECT concat('read', {_K}) AS name, true AS is_exported, concat('/// Reads ', {_K}, '.', chr(10), '/// Twice.') AS doc_comment FROM supplier
    UNION ALL SELECT concat('Plain', {_K}), false, '//! Inner.' FROM supplier UNION ALL SELECT concat('Bare', {_K}), false, NULL FROM supplier"""
)
def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "lib_mix").where("language = 'rust'")
    return resolved(nodes_of(extract_symbols(files, with_docs=True))).select("name", "is_exported", "doc_comment")


@_query(f"SELECT concat('py/p', {_K}, '.py') AS path, concat('class Box', {_K}, ':', chr(10), '    ...', chr(10), 'def open(self):', chr(10), '    ...', chr(10)) AS skeleton FROM supplier")
def skeleton_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "lib_mix").where("language = 'python'")
    return files.select("path", rewrite.skeleton_column(F.col("content"), F.col("language")).alias("skeleton"))


@_query(
    f"""SELECT 'open' AS wanted, concat('py/p', {_K}, '.py') AS from_file, concat('py/p', {_K}, '.py') AS file, 'def open(self)' AS signature FROM supplier
    UNION ALL SELECT 'open', NULL, (SELECT min(concat('py/p', {_K}, '.py')) FROM supplier), 'def open(self)'
    UNION ALL SELECT concat('read', {_K}), 'elsewhere.rs', concat('docs/d', {_K}, '.rs'), concat('pub fn read', {_K}, '()') FROM supplier UNION ALL SELECT 'nothing', NULL, NULL, NULL"""
)
def resolve_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that every file declares, asked for from each file and from nowhere; names of one file; one that nothing has."""
    files = corpus(spark, sf_dir, "lib_mix")
    own = files.where("language = 'python'").select(F.lit("open").alias("name"), F.col("path").alias("from_file"))
    one = files.where("language = 'rust'").select(F.concat(F.lit("read"), F.regexp_extract("path", "([0-9]+)", 1)), F.lit("elsewhere.rs"))
    rest = spark.sql("SELECT stack(2, 'open', CAST(NULL AS STRING), 'nothing', CAST(NULL AS STRING)) AS (name, from_file)")
    return CodeCorpus(files).resolve_symbols(own.union(one).union(rest)).select("wanted", "from_file", "file", "signature")


@_query(
    """SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'rust' WHEN 1 THEN 'tsx' WHEN 2 THEN 'javascript' WHEN 3 THEN 'python' WHEN 4 THEN 'vue' ELSE 'unknown' END AS language,
    n_nationkey % 7 IN (1, 2, 4) AS frontend FROM nation"""
)
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 7
    extension = F.when(k == 0, "rs").when(k == 1, " React-TSX ").when(k == 2, "mjs").when(k == 3, "PY").when(k == 4, "vue").when(k == 5, F.col("n_name"))
    named = _read(spark, sf_dir, "nation").select("n_nationkey", language_of(extension).alias("language"))
    return named.withColumn("frontend", is_frontend(F.col("language")))


@_query(f"SELECT path AS file, CAST(0 AS INT) AS ord, regexp_extract(content, 'use crate::(\\w+)', 1) AS target FROM ({SVC_RUST}) UNION ALL SELECT path, 0, regexp_extract(content, 'from ''([^'']+)''', 1) FROM ({RING_TS})")
def import_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(corpus(spark, sf_dir, "svc_rust").unionByName(corpus(spark, sf_dir, "ring_ts")))


@_query(f"SELECT language, kind, count(*) AS n_symbols FROM (SELECT 'rust' AS language, unnest(['Struct', 'Enum', 'Function']) AS kind FROM supplier UNION ALL SELECT 'typescript', unnest(['Trait', 'Function', 'Function']) FROM supplier UNION ALL SELECT 'python', unnest(['Struct', 'Function']) FROM supplier) GROUP BY ROLLUP (language, kind)")
def symbol_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "poly")
    return rollup_by_kind(nodes_of(extract_symbols(files)), files)


# --- graph over svc_rust ---

_NODES = f"SELECT concat('Service_', {_K}) AS name, 'Struct' AS kind, concat('src/service_', {_K}, '.rs') AS file, concat('pub struct Service_', {_K}) AS signature FROM supplier UNION ALL SELECT concat('run_service_', {_K}), 'Function', concat('src/service_', {_K}, '.rs'), concat('pub fn run_service_', {_K}, '(s: Service_', {_K}, ') -> u64') FROM supplier"
_EDGES = f"SELECT a.name AS from_name, b.name AS to_name FROM ({_NODES}) a JOIN ({_NODES}) b ON a.name <> b.name AND contains(a.signature, b.name)"
_REFS = f"SELECT DISTINCT token AS symbol, file, line FROM (SELECT path AS file, i AS line, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS token FROM (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM ({SVC_RUST}))) WHERE token IN (SELECT name FROM ({_NODES}))"


def _svc(spark: SparkSession, sf_dir: str) -> CodeCorpus:
    return CodeCorpus(corpus(spark, sf_dir, "svc_rust"))


@_query(f"SELECT to_name AS name, count(*) AS n_dependents FROM ({_EDGES}) GROUP BY 1")
def edges_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _svc(spark, sf_dir)
    return c.edges.groupBy("to_id").agg(F.count(F.lit(1)).alias("n_dependents")).join(c.nodes, F.col("to_id") == F.col("symbol_id")).select("name", "n_dependents")


def _followed(spark: SparkSession, sf_dir: str) -> CorpusIndex:
    """An index of the service corpus that came by changes: a third of the files first said something else, some were others."""
    index = CorpusIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    now = corpus(spark, sf_dir, "svc_rust").select("path", "language", "content")
    third = F.pmod(F.xxhash64("path"), F.lit(3)) == 0
    draft = F.when(third, F.replace("content", F.lit("Service_"), F.lit("Draft_"))).otherwise(F.col("content"))
    more = now.where(third).select(F.concat(F.lit("old/"), "path").alias("path"), "language", "content")
    index.upsert(now.select("path", "language", draft.alias("content")).union(more))
    index.upsert(now.where(third))
    index.remove(more)
    return index


@_query(f"SELECT to_name AS name, count(*) AS n_dependents FROM ({_EDGES}) GROUP BY 1")
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _followed(spark, sf_dir)
    counted = index.edges().groupBy("to_id").agg(F.count(F.lit(1)).alias("n_dependents"))
    return counted.join(index.read("nodes"), F.col("to_id") == F.col("symbol_id")).select("name", "n_dependents")


@_query(f"SELECT symbol, file, CAST(line AS BIGINT) AS line FROM ({_REFS})")
def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _followed(spark, sf_dir)
    index.compact()
    return index.read("references").select("symbol", "file", "line")


@_query(f"SELECT symbol, file, CAST(line AS BIGINT) AS line FROM ({_REFS})")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _svc(spark, sf_dir).references.select("symbol", "file", "line")


@_query(
    f"""SELECT r.symbol, r.file, CAST(r.line AS BIGINT) AS line, CAST(CASE r.line WHEN 1 THEN 0 ELSE list_sum(list_transform(list_slice(string_split(s.content, chr(10)), 1, r.line - 1), lambda x: length(x) + 1)) END AS BIGINT) AS byte_offset,
    string_split(s.content, chr(10))[r.line] AS context_snippet FROM ({_REFS}) r JOIN ({SVC_RUST}) s ON s.path = r.file"""
)
def reference_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _svc(spark, sf_dir).references


@_query(f"SELECT symbol, count(*) AS n_references FROM ({_REFS}) GROUP BY 1")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _svc(spark, sf_dir).references.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_references"))


@_query(f"SELECT concat(n.name, ' (', n.file, ':', n.signature, ')') AS orphan FROM ({_NODES}) n WHERE NOT EXISTS (SELECT 1 FROM ({_REFS}) r WHERE r.symbol = n.name AND r.file <> n.file)")
def orphan_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _svc(spark, sf_dir).orphan_exports()


_IMPACT = f"""
WITH RECURSIVE n AS ({_NODES}), e AS ({_EDGES}), r AS ({_REFS}),
walk AS (SELECT name AS start, name AS node, 0 AS depth FROM n UNION SELECT w.start, e.from_name, w.depth + 1 FROM walk w JOIN e ON e.to_name = w.node WHERE w.depth < 3),
near AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY 1, 2),
dep AS (
  SELECT near.start, near.depth, concat(n.name, ' (', n.file, ')') AS caller, n.file FROM near JOIN n ON n.name = near.node WHERE near.depth > 0
  UNION SELECT o.name, 1, concat(r.file, ':L', CAST(r.line AS STRING)), r.file FROM n o JOIN r ON r.symbol = o.name AND r.file <> o.file),
said AS (SELECT start, list_sort(coalesce(list(DISTINCT caller) FILTER (depth = 1), [])) AS direct_dependents, list_sort(coalesce(list(DISTINCT caller) FILTER (depth > 1), [])) AS transitive_dependents, list_sort(list(DISTINCT file)) AS affected_files FROM dep GROUP BY 1),
counted AS (SELECT symbol, count(*) AS c FROM r GROUP BY 1)
SELECT n.name AS symbol, n.file AS origin_file, array_to_string(coalesce(direct_dependents, []), '; ') AS direct_dependents, array_to_string(coalesce(transitive_dependents, []), '; ') AS transitive_dependents,
  array_to_string(coalesce(affected_files, []), '; ') AS affected_files, coalesce(c, 0) AS reference_count,
  CASE WHEN coalesce(c, 0) > 15 OR len(coalesce(affected_files, [])) > 5 THEN 'CRITICAL' WHEN coalesce(c, 0) >= 6 OR len(coalesce(affected_files, [])) >= 3 THEN 'HIGH' WHEN coalesce(c, 0) >= 2 OR len(coalesce(affected_files, [])) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_score
FROM n LEFT JOIN said ON said.start = n.name LEFT JOIN counted ON counted.symbol = n.name
"""


@_query(_IMPACT)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _svc(spark, sf_dir).impact_all(3)
    return found.withColumns({c: F.array_join(c, "; ") for c in ("direct_dependents", "transitive_dependents", "affected_files")})


@_query(f"SELECT risk_score, count(*) AS n_symbols FROM ({_IMPACT}) GROUP BY 1")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _svc(spark, sf_dir).impact_all(3).groupBy("risk_score").agg(F.count(F.lit(1)).alias("n_symbols"))


#: The links of the mesh corpus, and what reaches what over them.
_MESH = """links AS (
  SELECT a, 'n' || lpad(CAST(b AS VARCHAR), 9, '0') || '.ts' AS b FROM (
    SELECT 'n' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.ts' AS a, unnest([
      CASE WHEN s_suppkey % 10 <> 9 THEN s_suppkey + 1 END, CASE WHEN s_suppkey % 20 = 9 THEN s_suppkey - 9 END, CASE WHEN s_suppkey % 40 = 5 THEN s_suppkey + 5 END,
      CASE WHEN s_suppkey % 40 = 14 THEN s_suppkey - 9 END, CASE WHEN s_suppkey % 50 = 37 THEN s_suppkey END, CASE WHEN s_suppkey % 60 BETWEEN 40 AND 46 THEN s_suppkey + 2 END]) AS b FROM supplier)
  WHERE b IN (SELECT s_suppkey FROM supplier)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
placed AS (SELECT x.a, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@_query(f"WITH RECURSIVE {_MESH} SELECT a AS file, component FROM placed")
def import_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeCorpus(corpus(spark, sf_dir, "mesh_ts")).import_components().select(F.col("node").alias("file"), "component")


@_query(
    f"""WITH RECURSIVE {_MESH}, paths AS (
  SELECT a AS origin, b AS here, [a, b] AS path FROM links WHERE a < b
  UNION ALL
  SELECT origin, l.b, list_append(path, l.b) FROM paths p JOIN links l ON p.here = l.a WHERE p.here <> origin AND (l.b = origin OR (l.b > origin AND NOT list_contains(path, l.b))))
SELECT array_to_string(path, ',') AS cycle FROM paths WHERE here = origin UNION ALL SELECT a || ',' || b FROM links WHERE a = b"""
)
def mesh_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeCorpus(corpus(spark, sf_dir, "mesh_ts")).import_cycles().select(F.array_join("cycle", ",").alias("cycle"))


@_query(
    f"""WITH RECURSIVE {_MESH}, inside AS (SELECT x.component, l.a, l.b FROM links l JOIN placed x ON l.a = x.a JOIN placed y ON l.b = y.a AND x.component = y.component)
SELECT component, count(DISTINCT a) AS n_files, count(*) AS n_links, CASE WHEN count(*) > count(DISTINCT a) THEN 'mesh' WHEN count(DISTINCT a) = 1 THEN 'self' ELSE 'ring' END AS kind FROM inside GROUP BY component"""
)
def cyclic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeCorpus(corpus(spark, sf_dir, "mesh_ts")).cyclic_components()


@_query("SELECT concat('m', string_agg(CAST(n_nationkey AS STRING), '.ts,m' ORDER BY concat(CASE n_nationkey WHEN 0 THEN 'a' ELSE 'b' END, lpad(CAST(n_nationkey AS STRING), 3, '0'))), '.ts,m0.ts') AS cycle FROM nation")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CodeCorpus(corpus(spark, sf_dir, "ring_ts")).import_cycles().select(F.array_join("cycle", ",").alias("cycle"))


@_query(f"SELECT (SELECT count(*) FROM supplier) AS total_files, (SELECT count(*) FROM ({_NODES})) AS total_symbols, (SELECT count(*) FROM ({_EDGES})) AS total_edges, CAST(0 AS INT) AS n_cycles, (SELECT CAST(count(*) AS INT) FROM ({_NODES}) n WHERE NOT EXISTS (SELECT 1 FROM ({_REFS}) r WHERE r.symbol = n.name AND r.file <> n.file)) AS n_orphans")
def architectural_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _svc(spark, sf_dir).health()
    return found.select("total_files", "total_symbols", "total_edges", F.size("circular_dependencies").alias("n_cycles"), F.size("orphan_exports").alias("n_orphans"))


@_query(f"SELECT name, file, kind, signature, true AS is_exported, CAST(NULL AS STRING) AS doc_comment FROM ({_NODES})")
def resolved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _svc(spark, sf_dir)
    return resolved(c.nodes).select("name", "file", "kind", "signature", "is_exported", "doc_comment")


# --- rewrites ---


@_query(f"SELECT concat('src/service_', {_K}, '.rs') AS path, concat('pub struct Service_', {_K}, ';', chr(10), 'pub fn run_service_', {_K}, '(s: Service_', {_K}, ') -> u64;', chr(10)) AS skeleton FROM supplier")
def skeleton_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "svc_rust").select("path", rewrite.skeleton_column(F.col("content"), F.col("language")).alias("skeleton"))


_CARD = "CAST(c_custkey AS STRING)"


@_query(f"""SELECT concat('cards/c', {_CARD}, '.tsx') AS path, concat('"use client"', chr(10), 'import React from "react";', chr(10), chr(10), 'interface P', {_CARD}, ' {{ n: number }}', chr(10), chr(10), 'export function Card', {_CARD}, '(p: P', {_CARD}, ') {{', chr(10), '    // [JSX: ~6 nodes left out]', chr(10), '}}') AS skeleton FROM customer""")
def skeleton_tsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "tsx_cards").select("path", rewrite.skeleton_column(F.col("content"), F.col("language")).alias("skeleton"))


@_query(f"SELECT path, round((strlen(trim(content, concat(' ', chr(10)))) - strlen(skeleton)) / strlen(trim(content, concat(' ', chr(10)))) * 100.0, 6) AS saved FROM (SELECT path, content, concat('pub struct Service_', k, ';', chr(10), 'pub fn run_service_', k, '(s: Service_', k, ') -> u64;') AS skeleton FROM (SELECT *, regexp_extract(path, '([0-9]+)', 1) AS k FROM ({SVC_RUST})))")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "svc_rust")
    return files.select("path", F.round(rewrite.token_savings(F.col("content"), rewrite.skeleton_column(F.col("content"), F.col("language"))), 6).alias("saved"))


def _patches(files: DataFrame) -> DataFrame:
    key = F.regexp_extract("path", "([0-9]+)", 1)
    return files.select("path", F.concat(F.lit("run_service_"), key).alias("symbol"), F.concat(F.lit("  fn swapped_"), key, F.lit("() -> u64 { 7 }\n")).alias("new_code"))


@_query(f"SELECT path, concat('run_service_', k) AS symbol, true AS success, CAST(NULL AS STRING) AS stage, concat('pub struct Service_', k, ' {{ pub id: u64 }}', chr(10), 'fn swapped_', k, '() -> u64 {{ 7 }}', chr(10), substr(content, instr(content, 'use crate'))) AS patched, 3 AS lines_before, 3 AS lines_after FROM (SELECT *, regexp_extract(path, '([0-9]+)', 1) AS k FROM ({SVC_RUST}))")
def verified_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "svc_rust")
    return rewrite.verified_patches(_patches(files), files).select("path", "symbol", "success", "stage", "patched", "lines_before", "lines_after")


@_query(f"SELECT path, concat('// whole: run_service_', k, chr(10), chr(10), 'use crate::Service_', CAST(greatest(CAST(k AS BIGINT) - 1, 0) AS STRING), ';', chr(10), chr(10), 'pub fn run_service_', k, '(s: Service_', k, ') -> u64 {{ s.id }}') AS sliced_code FROM (SELECT *, regexp_extract(path, '([0-9]+)', 1) AS k FROM ({SVC_RUST}))")
def slice_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir, "svc_rust").withColumn("symbol", F.concat(F.lit("run_service_"), F.regexp_extract("path", "([0-9]+)", 1)))
    return files.select("path", rewrite.slice_column(F.col("content"), F.col("symbol"), F.lit(2), F.col("language")).getField("sliced_code").alias("sliced_code"))


@_query(
    f"""WITH n AS (SELECT *, CASE kind WHEN 'Struct' THEN 'struct' ELSE 'fn' END AS shown FROM ({_NODES})),
e AS (SELECT from_name AS a, to_name AS b FROM ({_EDGES}) UNION SELECT to_name, from_name FROM ({_EDGES})),
near AS (SELECT name AS s, name AS x FROM n UNION SELECT a, b FROM e UNION SELECT p.a, q.b FROM e p JOIN e q ON p.b = q.a)
SELECT s AS target_symbol, CAST(2 AS INT) AS depth, string_agg(name, '; ' ORDER BY file, kind DESC) AS included_symbols,
  concat(string_agg(concat(CASE WHEN name = s THEN '// > ' ELSE '//   ' END, file, ' ', shown, ' ', name), chr(10) ORDER BY file, kind DESC), chr(10), chr(10), string_agg(signature, chr(10) ORDER BY file, kind DESC)) AS sliced_code,
  CAST(85.0 AS DOUBLE) AS token_reduction_percent
FROM near JOIN n ON n.name = near.x GROUP BY s"""
)
def slice_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _svc(spark, sf_dir)
    return rewrite.slice_symbols(c, c.nodes.select(F.col("name").alias("symbol")), 2, separator="; ")


# --- contracts ---


@_query(
    f"""WITH w AS (SELECT p_partkey, language, list_filter(regexp_split_to_array(intent, '[^a-z0-9_]+'), lambda x: x <> '' AND x <> 'for') AS ws FROM ({INTENTS})),
    r AS (SELECT *, concat(upper(ws[1][1]), substr(ws[1], 2), upper(ws[2][1]), substr(ws[2], 2)) AS root FROM w)
    SELECT p_partkey, CASE language WHEN 'tsx' THEN root ELSE concat(ws[1], '_', ws[2]) END AS primary_symbol,
      concat(root, CASE language WHEN 'rust' THEN 'Request' WHEN 'tsx' THEN 'Props' ELSE 'Input' END) AS input_type,
      concat(root, CASE language WHEN 'rust' THEN 'Response' WHEN 'tsx' THEN 'State' ELSE 'Output' END) AS output_type,
      CASE language WHEN 'rust' THEN concat(root, 'Error') WHEN 'tsx' THEN '' ELSE concat(root, 'Exception') END AS error_type FROM r"""
)
def contract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = contracts.contract_names(corpus(spark, sf_dir, "intents"))
    return named.select("p_partkey", "primary_symbol", "input_type", "output_type", "error_type")


@_query(f"SELECT p_partkey, CASE language WHEN 'tsx' THEN 3 ELSE 4 END AS n_required, CASE language WHEN 'rust' THEN 4 WHEN 'tsx' THEN 6 ELSE 3 END AS n_invariants FROM ({INTENTS})")
def contract_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = contracts.synthesize(corpus(spark, sf_dir, "intents"))
    return made.select("p_partkey", F.size("required_symbols").alias("n_required"), F.size("invariant_checklist").alias("n_invariants"))


@_query(f"SELECT p_partkey, p_partkey % 2 = 0 AS passed, CASE p_partkey % 2 WHEN 0 THEN 0 WHEN 1 THEN CASE language WHEN 'tsx' THEN 3 ELSE 4 END END AS n_missing FROM ({INTENTS})")
def contract_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = contracts.synthesize(corpus(spark, sf_dir, "intents"))
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("// "), F.array_join("required_symbols", " "))).otherwise("// nothing")
    return contracts.verify_contracts(made.withColumn("generated_code", code)).select("p_partkey", "passed", F.size("missing_symbols").alias("n_missing"))


@_query(
    f"""WITH w AS (SELECT p_partkey, language, intent, list_filter(regexp_split_to_array(intent, '[^a-z0-9_]+'), lambda x: x <> '' AND x <> 'for') AS ws FROM ({INTENTS})),
    r AS (SELECT *, concat(upper(ws[1][1]), substr(ws[1], 2), upper(ws[2][1]), substr(ws[2], 2)) AS root, concat(ws[1], '_', ws[2]) AS snake, concat(chr(10), chr(10)) AS gap FROM w)
    SELECT p_partkey, CASE language
      WHEN 'rust' THEN concat('// ', intent, gap, '#[derive(Clone, Debug)]', chr(10), 'pub struct ', root, 'Request;', gap, '#[derive(Clone, Debug)]', chr(10), 'pub struct ', root, 'Response;', gap,
        '#[derive(Debug)]', chr(10), 'pub struct ', root, 'Error(pub String);', gap, 'pub async fn ', snake, '(given: ', root, 'Request) -> Result<', root, 'Response, ', root, 'Error> {{', chr(10), '    todo!()', chr(10), '}}', chr(10))
      WHEN 'tsx' THEN concat('// ', intent, gap, 'export interface ', root, 'Props {{}}', gap, 'export interface ', root, 'State {{}}', gap, 'export declare const ', root, ': (given: ', root, 'Props) => JSX.Element;', chr(10))
      ELSE concat('# ', intent, gap, 'class ', root, 'Input(dict):', chr(10), '    pass', gap, 'class ', root, 'Output(dict):', chr(10), '    pass', gap, 'class ', root, 'Exception(Exception):', chr(10), '    pass', gap,
        'async def ', snake, '(given: ', root, 'Input) -> ', root, 'Output:', chr(10), '    raise NotImplementedError', chr(10)) END AS type_scaffolding FROM r"""
)
def contract_scaffolding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.synthesize(corpus(spark, sf_dir, "intents")).select("p_partkey", "type_scaffolding")


# --- hashes, cache ---


@_query("SELECT sha256(concat(event_type, CAST(user_id AS STRING))) AS content_hash, count(*) AS n_files, min(CAST(event_id AS STRING)) AS first_path FROM events GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return cache.dedupe_contents(events.select(F.col("event_id").cast("string").alias("path"), F.concat("event_type", F.col("user_id").cast("string")).alias("content")))


@_query(
    """WITH RECURSIVE data AS (SELECT p_partkey AS k, concat('target:', p_name, ':Function') AS t FROM part),
    h AS (SELECT k, t, 1 AS i, CAST(14695981039346656037 AS HUGEINT) AS v FROM data
      UNION ALL SELECT k, t, i + 1, CAST(xor(CAST(v AS UBIGINT), CAST(ascii(substr(t, i, 1)) AS UBIGINT)) AS HUGEINT) * 1099511628211 % 18446744073709551616 FROM h WHERE i <= length(t))
    SELECT k AS p_partkey, lower(lpad(hex(CAST(v AS UBIGINT)), 16, '0')) AS symbol_id FROM h WHERE i = length(t) + 1"""
)
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", fnv1a64_column(F.concat(F.lit("target:"), "p_name", F.lit(":Function"))).alias("symbol_id"))


@_query()
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    ops = events.select((F.col("user_id") % 16).cast("string").alias("cache_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "get").otherwise("insert").alias("op"), F.concat("event_type", F.col("user_id").cast("string")).alias("content"))
    return cache.replay(ops, 32).groupBy("cache_id").agg(F.count_if(F.col("hit")).alias("hits"), F.count("evicted").alias("evictions"), F.max("n_entries").alias("most_entries"))


@_query(
    """WITH ops AS (SELECT CAST(user_id % 16 AS STRING) AS cache_id, event_id AS seq, concat(event_type, CAST(user_id AS STRING)) AS content, event_id % 3 = 0 AS is_get FROM events),
    last AS (SELECT g.cache_id, g.seq, max(i.seq) AS inserted FROM ops g LEFT JOIN ops i ON i.cache_id = g.cache_id AND i.content = g.content AND i.seq < g.seq AND NOT i.is_get WHERE g.is_get GROUP BY 1, 2)
    SELECT cache_id, seq, inserted IS NOT NULL AS hit, CASE WHEN inserted IS NOT NULL THEN concat('of ', CAST(inserted AS STRING)) END AS skeleton, CAST(inserted % 100 AS INT) AS n_symbols FROM last"""
)
def cache_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gets have back from caches so large that nothing is evicted: what the last insert of the content put in."""
    seq = F.col("event_id")
    ops = _read(spark, sf_dir, "events").select(
        (F.col("user_id") % 16).cast("string").alias("cache_id"), seq.alias("seq"), F.when(seq % 3 == 0, "get").otherwise("insert").alias("op"), F.concat("event_type", F.col("user_id").cast("string")).alias("content"),
        F.concat(F.lit("of "), seq.cast("string")).alias("skeleton"), (seq % 100).alias("n_symbols"),
    )
    return cache.replay(ops, 1 << 20).where("op = 'get'").select("cache_id", "seq", "hit", "skeleton", "n_symbols")
