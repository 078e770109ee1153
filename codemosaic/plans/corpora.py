"""Synthetic code corpora made by SQL from the driver's tables: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

#: 100 modules at sf0.01: a struct, a function that takes it, and a use of the module before.
SVC_RUST = f"""
SELECT concat('src/service_', CAST(s_suppkey AS STRING), '.rs') AS path, 'rust' AS language,
  concat('pub struct Service_', CAST(s_suppkey AS STRING), ' {{ pub id: u64 }}', {NL},
    'pub fn run_service_', CAST(s_suppkey AS STRING), '(s: Service_', CAST(s_suppkey AS STRING), ') -> u64 {{ s.id }}', {NL},
    'use crate::Service_', CAST(greatest(s_suppkey - 1, 0) AS STRING), ';', {NL}) AS content
FROM supplier
"""

#: Three Rust, three TypeScript and two Python declarations for each key.
POLY = f"""
SELECT concat('rs/mod_', CAST(s_suppkey AS STRING), '.rs') AS path, 'rust' AS language,
  concat('pub struct Item', CAST(s_suppkey AS STRING), ' {{ v: u32 }}', {NL}, 'pub enum Kind', CAST(s_suppkey AS STRING), ' {{ A, B }}', {NL},
    'pub async fn load', CAST(s_suppkey AS STRING), '(k: Kind', CAST(s_suppkey AS STRING), ') {{ }}', {NL}) AS content FROM supplier
UNION ALL
SELECT concat('ts/mod_', CAST(s_suppkey AS STRING), '.ts'), 'typescript',
  concat('export interface Row', CAST(s_suppkey AS STRING), ' {{ id: number }}', {NL}, 'export function fetch', CAST(s_suppkey AS STRING), '(r: Row', CAST(s_suppkey AS STRING), ') {{ return r }}', {NL},
    'export const pick', CAST(s_suppkey AS STRING), ' = (x) => x;', {NL}) FROM supplier
UNION ALL
SELECT concat('py/mod_', CAST(s_suppkey AS STRING), '.py'), 'python',
  concat('class Box', CAST(s_suppkey AS STRING), ':', {NL}, '    size = 1', {NL}, 'def open', CAST(s_suppkey AS STRING), '(b):', {NL}, '    return b', {NL}) FROM supplier
"""

#: 25 files, each importing the next, the last the first.
RING_TS = f"""
SELECT concat('m', CAST(n_nationkey AS STRING), '.ts') AS path, 'typescript' AS language,
  concat('import {{ x }} from ''m', CAST((n_nationkey + 1) % 25 AS STRING), '.ts'';', {NL}, 'export const v', CAST(n_nationkey AS STRING), ' = () => 1;', {NL}) AS content
FROM nation
"""

#: A snippet for each part, of a dozen families of violations and safe code.
GUARD_MIX = f"""
SELECT concat('g', CAST(p_partkey AS STRING)) AS path, 'rust' AS language, CASE p_partkey % 13
  WHEN 0 THEN concat('fn ok', CAST(p_partkey AS STRING), '(a: u32) -> u32 {{ a + 1 }}')
  WHEN 1 THEN concat('fn div', CAST(p_partkey AS STRING), '(a: f64, b: f64) -> f64 {{ a / b }}')
  WHEN 2 THEN concat('fn at', CAST(p_partkey AS STRING), '(v: &[u32], i: usize) -> u32 {{ v[i] }}')
  WHEN 3 THEN concat('fn un', CAST(p_partkey AS STRING), '(m: Map) -> u32 {{ m.first().unwrap() }}')
  WHEN 4 THEN concat('use std::sync::Mutex;', {NL}, 'async fn mu', CAST(p_partkey AS STRING), '() {{ tick().await; }}')
  WHEN 5 THEN concat('function C', CAST(p_partkey AS STRING), '(a) {{', {NL}, '  if (a) {{', {NL}, '    useState(0);', {NL}, '  }}', {NL}, '}}')
  WHEN 6 THEN concat('"use client"', {NL}, 'const k', CAST(p_partkey AS STRING), ' = process.env.SECRET_', CAST(p_partkey AS STRING), ';')
  WHEN 7 THEN concat('const h', CAST(p_partkey AS STRING), ' = set({{ dangerouslySetInnerHTML={{{{ __html: body }}}} }})')
  WHEN 8 THEN concat('export const d', CAST(p_partkey AS STRING), ' = a.b.c;')
  WHEN 9 THEN concat('fn open', CAST(p_partkey AS STRING), '(a: u32 {{')
  WHEN 10 THEN concat('const r', CAST(p_partkey AS STRING), ' = "(a+)+$";')
  WHEN 11 THEN concat('const t', CAST(p_partkey AS STRING), ' = <div><span></div></span>;')
  ELSE concat('"use client"', {NL}, 'const p', CAST(p_partkey AS STRING), ' = process.env.NEXT_PUBLIC_A;') END AS content
FROM part
"""

#: A statement of intent for each part.
INTENTS = """
SELECT p_partkey, concat(lower(p_type), ' report for ', lower(p_brand)) AS intent, CASE p_partkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'tsx' ELSE 'python' END AS language
FROM part
"""

#: Client components: a directive, an import, a props interface and a component.
TSX_CARDS = f"""
SELECT concat('cards/c', CAST(c_custkey AS STRING), '.tsx') AS path, 'tsx' AS language,
  concat('"use client"', {NL}, 'import React from "react";', {NL}, 'interface P', CAST(c_custkey AS STRING), ' {{ n: number }}', {NL},
    'export function Card', CAST(c_custkey AS STRING), '(p: P', CAST(c_custkey AS STRING), ') {{', {NL}, '  return <div><b>{{p}}</b><i>x</i></div>;', {NL}, '}}', {NL}) AS content
FROM customer
"""

#: Imports by relative paths and by ends of paths, doc comments, and a name that every Python file declares.
LIB_MIX = f"""
SELECT concat('lib/a', CAST(s_suppkey AS STRING), '.ts') AS path, 'typescript' AS language,
  concat('import {{ x }} from "./b', CAST(s_suppkey AS STRING), '";', {NL}, 'export {{ y }} from "../c', CAST(s_suppkey AS STRING), '";', {NL}, 'export const v = () => 1;', {NL}) AS content FROM supplier
UNION ALL
SELECT concat('use/u', CAST(s_suppkey AS STRING), '.ts'), 'typescript',
  concat('import {{ v }} from "a', CAST(s_suppkey AS STRING), '.ts";', {NL}, 'import {{ w }} from "far/lib/a', CAST(s_suppkey AS STRING), '.ts";', {NL}) FROM supplier
UNION ALL
SELECT concat('docs/d', CAST(s_suppkey AS STRING), '.rs'), 'rust',
  concat('/// Reads ', CAST(s_suppkey AS STRING), '.', {NL}, '/// Twice.', {NL}, 'pub fn read', CAST(s_suppkey AS STRING), '() {{ 1 }}', {NL}, '//! Inner.', {NL}, 'struct Plain', CAST(s_suppkey AS STRING), ';', {NL}, 'enum Bare', CAST(s_suppkey AS STRING), ' {{ A }}', {NL}) FROM supplier
UNION ALL
SELECT concat('py/p', CAST(s_suppkey AS STRING), '.py'), 'python',
  concat('import os', {NL}, 'from pkg.mod', CAST(s_suppkey AS STRING), ' import name', {NL}, 'class Box', CAST(s_suppkey AS STRING), ':', {NL}, '    def open(self):', {NL}, '        return 1', {NL}) FROM supplier
"""

#: Files in chains of ten: some close to rings, two rings share a file, some import themselves, some also what lies two on.
MESH_TS = f"""
SELECT concat('n', lpad(CAST(s_suppkey AS STRING), 9, '0'), '.ts') AS path, 'typescript' AS language,
  concat(
    CASE WHEN s_suppkey % 10 <> 9 THEN concat('import {{ a }} from "n', lpad(CAST(s_suppkey + 1 AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    CASE WHEN s_suppkey % 20 = 9 THEN concat('import {{ b }} from "n', lpad(CAST(s_suppkey - 9 AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    CASE WHEN s_suppkey % 40 = 5 THEN concat('import {{ c }} from "n', lpad(CAST(s_suppkey + 5 AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    CASE WHEN s_suppkey % 40 = 14 THEN concat('export {{ d }} from "n', lpad(CAST(s_suppkey - 9 AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    CASE WHEN s_suppkey % 50 = 37 THEN concat('import {{ e }} from "n', lpad(CAST(s_suppkey AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    CASE WHEN s_suppkey % 60 BETWEEN 40 AND 46 THEN concat('import {{ f }} from "n', lpad(CAST(s_suppkey + 2 AS STRING), 9, '0'), '.ts";', {NL}) ELSE '' END,
    'export const x = 1;', {NL}) AS content
FROM supplier
"""

_TABLES = {"mesh_ts": (MESH_TS, ["supplier"]), "svc_rust": (SVC_RUST, ["supplier"]), "poly": (POLY, ["supplier"]), "ring_ts": (RING_TS, ["nation"]), "guard_mix": (GUARD_MIX, ["part"]), "intents": (INTENTS, ["part"]), "lib_mix": (LIB_MIX, ["supplier"]), "tsx_cards": (TSX_CARDS, ["customer"])}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = _TABLES[name]
    return spark.sql(_bound(sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _bound(sql: str) -> str:
    """The text with its tables as parameters, and braces of code kept."""
    return re.sub(r"\bFROM (\w+)", r"FROM {\1}", sql.replace("{", "{{").replace("}", "}}"))
