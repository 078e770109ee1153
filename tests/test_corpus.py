import random
import re

import pytest

from codemosaic.functions.hashing import fnv1a64, fnv1a64_column
from codemosaic.functions.languages import EXTENSIONS, extension_of, language_named, language_of
from codemosaic.operators import rewrite
from codemosaic.operators.cache import Lru, replay
from codemosaic.operators.contracts import contract_names, synthesize, verify_contracts
from codemosaic.operators.graph import CodeCorpus, centres, edges, numbered, references
from codemosaic.operators.symbols import extract_symbols, imports, nodes_of, resolved
from codemosaic.plans.corpora import corpus

FILES = "path string, language string, content string"
SMALL = "/root/testdata/sf0.01"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


# --- functions ---


def test_hashes(spark):
    from pyspark.sql import functions as F

    texts = ["", "abc", "src/é.rs:名:Function", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a64_column(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: fnv1a64(t.encode()) for t in texts}
    assert fnv1a64(b"") == "cbf29ce484222325" and fnv1a64(b"a") == "af63dc4c8601ec8c"


def test_languages(spark):
    from pyspark.sql import functions as F

    rows = [(f"d/x.{e}", lang) for lang, names in EXTENSIONS.items() for e in names] + [("x.RS", "rust"), ("Makefile", "unknown"), ("a.b/c", "unknown"), (".rs", "unknown"), ("x.txt", "unknown")]
    got = spark.createDataFrame(rows, "path string, want string").select("want", language_of(extension_of(F.col("path"))).alias("got")).collect()
    assert all(r.want == r.got for r in got) and language_named(None) == "unknown" and language_named(" TS ") == "typescript"


# --- symbols ---


def test_rust_symbols(spark):
    code = "use a::b;\n\n/// Says so.\n/// Twice.\npub struct A<'a> { x: &'a str }\n\n#[derive(X)]\nenum B { C }\npub(crate) async fn run(a: A, f: fn(u8) -> u8) -> u8 {\n    let s = \"}\"; '{'; { 1 }\n}\ntype T = u8;\ntrait Q;\nconst fn no() {}\n"
    rows = {r.name: r for r in extract_symbols(files(spark, [("m.rs", "rust", code)]), with_text=True).collect()}
    assert {n: (r.kind, r.signature) for n, r in rows.items()} == {
        "A": ("Struct", "pub struct A<'a>"), "B": ("Enum", "enum B"), "run": ("Function", "pub(crate) async fn run(a: A, f: fn(u8) -> u8) -> u8"), "T": ("TypeAlias", "type T = u8"), "Q": ("Trait", "trait Q"),
    }
    assert all(code.encode()[r.byte_start : r.byte_end].decode() == r.text for r in rows.values())
    assert rows["run"].text.endswith("{ 1 }\n}") and rows["A"].symbol_id == fnv1a64(b"m.rs:A:Struct")
    docs = {r.name: (r.doc_comment, r.is_exported) for r in resolved(nodes_of(extract_symbols(files(spark, [("m.rs", "rust", code)]), with_docs=True))).collect()}
    assert docs["A"] == ("/// Says so.\n/// Twice.", True) and docs["B"] == (None, False) and docs["run"] == (None, True)


def test_typescript_symbols(spark):
    code = "export default async function go(a: { b: string }) { return a }\nconst pick = async (x) => x;\nlet plain = 3;\nexport class K { m() {} }\ninterface P { n: number }\nexport type U = { a: 1 };\nconst odd: F = y => y\n"
    got = {r.name: (r.kind, r.signature) for r in extract_symbols(files(spark, [("m.ts", "typescript", code)])).collect()}
    assert got == {
        "go": ("Function", "export default async function go(a: { b: string })"), "pick": ("Function", "const pick = async (x) => x"), "K": ("Struct", "export class K"), "P": ("Trait", "interface P"),
        "U": ("TypeAlias", "export type U ="), "odd": ("Function", "const odd: F = y => y"),
    }


def test_python_spans(spark):
    code = "import os\n\ndef f(x: int):\n    return x\n\nclass B:\n    def g(self):\n        # c\n        pass\nasync def h():\n    pass\n"
    got = {r.name: r for r in extract_symbols(files(spark, [("m.py", "python", code)])).collect()}
    # a match starts at the blank line before its declaration, which then is an empty span
    assert got["f"].byte_start == got["f"].byte_end == code.index("\ndef f") and got["f"].signature == "\ndef f"
    assert code[got["g"].byte_start : got["g"].byte_end] == "    def g(self):\n        # c\n        pass" and got["g"].signature == "def g(self)"
    assert code[got["h"].byte_start :] == "async def h():\n    pass\n"


def test_equal_symbols_stand_once(spark):
    found = extract_symbols(files(spark, [("m.rs", "rust", "fn a() { 1 }\nfn a() { 2 }\nstruct a;\n"), ("n.rs", "rust", None), ("o.txt", "unknown", "fn x() {}")]))
    nodes = nodes_of(found).collect()
    assert found.count() == 3 and {(r.kind, r.byte_start) for r in nodes} == {("Function", 13), ("Struct", 26)}


def test_imports(spark):
    rows = [
        ("src/a.rs", "rust", "use crate::b::C;\npub use super::d;\nmod e;\n"), ("src/a.ts", "typescript", "import { x } from './b';\nimport 'side';\nexport * from \"../c\";\nimport y from 'lib';\n"),
        ("p.py", "python", "from a.b import c\nimport d.e, f\n"), ("top.ts", "tsx", "import z from './q';\n"),
    ]
    got = {}
    for r in imports(files(spark, rows)).collect():
        got.setdefault(r.file, []).append((r.ord, r.target))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {"src/a.rs": ["b::C", "d", "e.rs"], "src/a.ts": ["src/./b", "lib", "src/../c"], "p.py": ["a.b", "d.e"], "top.ts": ["q"]}


# --- graph ---


def test_edges_and_references_equal_brute_force(spark):
    r = random.Random(2)
    names = ["a", "ab", "abc", "run", "run_all", "$", "$x", "x$y", "VeryLongSymbolName", "VeryLongSymbolNameToo", "b1"]
    rows = []
    for i in range(12):
        lines = [f"export function {n}{r.choice(['', i])}({r.choice(names)}, {r.choice(names)}Z) {{ return {r.choice(names)} }}" for n in r.sample(names, 4)] + [f"// {names[0]}", f"  {r.choice(names)}.{r.choice(names)} $ {r.choice(names)}", "# ab", "é" + r.choice(names)]
        rows.append((f"f{i}.ts", "typescript", "\n".join(lines) + "\r\n"))
    df = files(spark, rows)
    nodes = nodes_of(extract_symbols(df)).cache()
    all_nodes = nodes.collect()
    holder = {}
    for n in sorted(all_nodes, key=lambda n: (n.file, n.pattern_ord, n.byte_start, n.symbol_id)):
        holder.setdefault(n.name, n.symbol_id)
    expected = {(n.symbol_id, to) for n in all_nodes for name, to in holder.items() if to != n.symbol_id and name in n.signature}
    assert {(e.from_id, e.to_id) for e in edges(nodes).collect()} == expected
    said = set()
    for path, _, content in rows:
        for i, line in enumerate(content.split("\n")):
            if not line.strip().startswith(("//", "#", "*")):
                said |= {(n, path, i + 1) for n in holder if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", line)}
    assert {(x.symbol, x.file, x.line) for x in references(df, nodes).collect()} == said


def test_known_impact(spark):
    c = CodeCorpus(corpus(spark, SMALL, "svc_rust"))
    r = c.impact("Service_0", "src/service_0.rs", 3).first()
    assert (r.reference_count, r.direct_dependents, r.transitive_dependents, r.affected_files, r.risk_score) == (4, ["run_service_0 (src/service_0.rs)", "src/service_1.rs:L3"], [], ["src/service_0.rs", "src/service_1.rs"], "MEDIUM")
    none = c.impact("nothing", None, 2).first()
    assert (none.origin_file, none.risk_score, none.reference_count, none.direct_dependents) == ("unknown", "LOW", 0, [])
    assert c.resolve_symbol("run_service_5").first().file == "src/service_5.rs" and c.resolve_symbol("nothing").isEmpty()
    assert [x.line for x in c.find_references("Service_7").collect()] == [1, 2, 3]


def test_impact_over_several_steps(spark):
    rows = [("a.rs", "rust", "pub struct Alpha { x: u8 }\n"), ("b.rs", "rust", "pub fn beta_fn(a: Alpha) {}\n"), ("c.rs", "rust", "pub type GammaT = fn(beta_fn);\n"), ("d.rs", "rust", "pub fn delta_fn(x: GammaT) {}\n")]
    c = CodeCorpus(files(spark, rows))
    r = c.impact("Alpha", None, 2).first()
    assert r.direct_dependents == ["b.rs:L1", "beta_fn (b.rs)"] and r.transitive_dependents == ["GammaT (c.rs)"]
    assert c.impact("Alpha", None, 3).first().transitive_dependents == ["GammaT (c.rs)", "delta_fn (d.rs)"]


def test_cycles_orphans_health(spark):
    ts = lambda *to: "".join(f"import {{ x }} from '{t}';\n" for t in to)
    rows = [("a.ts", "typescript", ts("b.ts", "e.ts")), ("b.ts", "typescript", ts("c.ts")), ("c.ts", "typescript", ts("a.ts", "b.ts")), ("self.ts", "typescript", ts("self.ts")), ("e.ts", "typescript", ts("lib")), ("deep/b2.ts", "typescript", ts("x/deep/b2.ts"))]
    c = CodeCorpus(files(spark, rows))
    assert sorted(tuple(r.cycle) for r in c.import_cycles().collect()) == [("a.ts", "b.ts", "c.ts", "a.ts"), ("b.ts", "c.ts", "b.ts"), ("deep/b2.ts", "deep/b2.ts"), ("self.ts", "self.ts")]
    assert [len(r.cycle) for r in c.import_cycles(most=1).collect()] == [2, 2]
    used = CodeCorpus(files(spark, [("a.rs", "rust", "pub fn used() {}\npub fn alone() {}\npub fn main() {}\nfn private() {}\n"), ("b.rs", "rust", "fn x() { used(); }\n")]))
    assert [r.orphan for r in used.orphan_exports().collect()] == ["alone (a.rs:pub fn alone())"]
    h = used.health().first()
    assert (h.total_files, h.total_symbols, h.circular_dependencies, h.orphan_exports) == (2, 5, [], ["alone (a.rs:pub fn alone())"])
    more = used.upsert(files(spark, [("b.rs", "rust", "fn x() { alone(); }\n")]))
    assert [r.orphan for r in more.orphan_exports().collect()] == ["used (a.rs:pub fn used())"]


# --- rewrites ---


def test_patch():
    src = "use x;\n\npub fn a(v: u8) -> u8 { v }\n\npub fn b() {}\n"
    out, error = rewrite.patched(src, "a", "\n  pub fn a() -> u8 { 7 }\n", "rust")
    assert error is None and out == "use x;\npub fn a() -> u8 { 7 }\n\npub fn b() {}\n"
    assert rewrite.patched(src, "none", "x", "rust") == (None, "Symbol not found: none")
    own = next(s for s in rewrite.spans(out, "rust") if s.name == "b")
    assert rewrite.patched(out, "b", own.text, "rust")[0].replace("\n", "") == out.replace("\n", "")


def test_skeletons():
    tsx = "\"use client\"\nimport R from 'r';\ninterface P { n: number }\nexport function Card(p: P) {\n  return <div>" + "<p>text of a long body</p>" * 20 + "</div>;\n}\nfunction helper(a) { return a }\n"
    out = rewrite.skeleton(tsx, "tsx")
    assert out.startswith("\"use client\"\nimport R from 'r';\n\ninterface P { n: number }\n\n") or "interface P { n: number }" in out
    assert "~42 nodes" in out and "long body" not in out and "function helper(a);" in out and len(out) < len(tsx) / 2
    assert rewrite.skeleton("x = 1\n", "python") == "x = 1\n" and rewrite.skeleton("def f(a):\n    return a\n", "python") == "def f(a):\n    ...\n"


def test_slices(spark):
    src = "use a;\nstruct S { x: u8 }\nfn go(s: S) { 1 }\nfn other() {}\n"
    assert rewrite.sliced(src, "go", 2, "rust")[0] == ["go"] and rewrite.sliced(src, "go", 2, "rust", True)[0] == ["S", "go"]
    names, text, saved = rewrite.sliced(src, "missing", 2, "rust")
    assert names == [] and text == rewrite.skeleton(src, "rust") and 0 <= saved <= 100
    c = CodeCorpus(files(spark, [("m.rs", "rust", src)]))
    r = rewrite.slice_corpus(c, "go", 1).first()
    assert r.included_symbols == ["S", "go"] and r.sliced_code.startswith("//   ") and "// > " in r.sliced_code and r.sliced_code.endswith("\nfn go(s: S)") and r.token_reduction_percent == 85.0
    none = rewrite.slice_corpus(c, "missing", 1).first()
    assert none.included_symbols == [] and none.sliced_code == "" and none.token_reduction_percent == 0.0


def test_verified_patches(spark):
    df = files(spark, [("a.rs", "rust", "fn a() { 1 }\n"), ("b.rs", "rust", "fn b(x: u8 {\n")])
    patches = spark.createDataFrame([("a.rs", "a", "fn a() { 2 }"), ("a.rs", "z", "fn z() {}"), ("a.rs", "a", "fn a( {"), ("b.rs", "b", "fn b() {}"), ("no.rs", "b", "fn b() {}")], "path string, symbol string, new_code string")
    got = {(r.path, r.symbol, r.stage): r for r in rewrite.verified_patches(patches, df).collect()}
    assert got["a.rs", "a", None].patched == "fn a() { 2 }\n" and ("a.rs", "z", "ast_patch_execution") in got and got["a.rs", "a", "pre_patch_safety_verification"].violation == "UNBALANCED_DELIMITERS"
    assert ("no.rs", "b", "ast_patch_execution") in got and len(got) == 5


# --- contracts ---


@pytest.mark.parametrize(
    ("intent", "language", "names"),
    [
        ("calculate user stats", "rust", ("user_stats", "UserStatsRequest", "UserStatsResponse", "UserStatsError")),
        ("useDebounce custom hook with delay and cancel", "tsx", ("useDebounceCustom", "UseDebounceCustomOptions", "UseDebounceCustomReturn", "")),
        ("paginate and filter database records by tenant", "python", ("paginate_filter", "PaginateFilterInput", "PaginateFilterOutput", "PaginateFilterException")),
        ("Dashboard card", "tsx", ("Dashboard", "DashboardProps", "DashboardState", "")),
        ("create the", "rust", ("execute_handler", "ExecuteHandlerRequest", "ExecuteHandlerResponse", "ExecuteHandlerError")),
        ("2fast lookup", "typescript", ("2fastLookup", "2fastLookupParams", "2fastLookupResult", "2fastLookupError")),
    ],
)
def test_contract_names(spark, intent, language, names):
    r = contract_names(spark.createDataFrame([(intent, language)], "intent string, language string")).first()
    assert (r.primary_symbol, r.input_type, r.output_type, r.error_type) == names


def test_contracts(spark):
    made = synthesize(spark.createDataFrame([("calculate user stats", "unknown", None), ("list auth tokens page", "unknown", "x/y.py"), ("x", "unknown", "a.txt")], "intent string, language string, target_path string"))
    by = {r.intent: r for r in made.collect()}
    assert by["calculate user stats"].language == "rust" and len(by["calculate user stats"].invariant_checklist) == 4 and "pub async fn user_stats" in by["calculate user stats"].type_scaffolding
    assert by["list auth tokens page"].language == "python" and len(by["list auth tokens page"].invariant_checklist) == 5 and by["x"].language == "unknown"
    from pyspark.sql import functions as F

    one = made.where("language = 'rust'")
    good = "struct UserStatsRequest; struct UserStatsResponse; enum UserStatsError {}\nfn user_stats() {}"
    r = verify_contracts(one.withColumn("generated_code", F.lit(good))).first()
    assert r.passed and r.missing_symbols == []
    r = verify_contracts(one.withColumn("generated_code", F.lit("fn other(a: u8, b: u8) -> u8 { a / b }"))).first()
    assert not r.passed and len(r.missing_symbols) == 4 and r.safety_violation == "DIV_BY_ZERO" and r.detail.count("; ") == 2


# --- cache ---


def test_cache_order(spark):
    ops = [("c", 1, "insert", "a"), ("c", 2, "insert", "b"), ("c", 3, "get", "a"), ("c", 4, "insert", "c"), ("c", 5, "get", "b"), ("c", 6, "get", "a"), ("d", 1, "get", "a"), ("c", 7, "insert", "a")]
    got = {(r.cache_id, r.seq): r for r in replay(spark.createDataFrame(ops, "cache_id string, seq long, op string, content string"), 2).collect()}
    assert [got["c", i].hit for i in (3, 5, 6)] == [True, False, True] and not got["d", 1].hit
    assert got["c", 4].evicted == got["c", 2].content_hash and got["c", 7].evicted == got["c", 4].content_hash and got["c", 7].n_entries == 1 + (got["c", 7].evicted is not None) * 0
    lru = Lru(1)
    assert lru.insert("a") is None and lru.insert("a") == "a" and list(lru.entries) == ["a"]


def test_a_common_name_asked_for_from_every_file_is_not_joined_by_pairs(spark):
    n = 3000
    rows = [(f"p{i:04}.py", "python", "def open(self):\n    return 1\n\nclass open:\n    pass\n") for i in range(n)]
    c = CodeCorpus(files(spark, rows))
    asked = [("open", p) for p, _, _ in rows] + [("open", None), ("open", "elsewhere.py"), ("nothing", None), (None, "p0001.py")]
    out = c.resolve_symbols(spark.createDataFrame(asked, "name string, from_file string"))
    got = {(r.wanted, r.from_file): (r.file, r.kind) for r in out.collect()}
    assert got == {("open", p): (p, "Function") for p, _, _ in rows} | {("open", None): ("p0000.py", "Function"), ("open", "elsewhere.py"): ("p0000.py", "Function"), ("nothing", None): (None, None), (None, "p0001.py"): (None, None)}
    assert most_rows_of_a_join(spark, out) <= 2 * len(asked)
    c.unpersist()


def most_rows_of_a_join(spark, df):
    """The most rows that a join of a plan that has run made."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_slices_equal_brute_force_and_share_what_they_list(spark):
    r = random.Random(5)
    for n, many, task_bytes in ((14, 2, 1 << 29), (40, 1, 300)):
        names = [f"n{i:02}q" for i in range(n)]
        rows = [(f"f{i % 5}_{x}.rs", "rust", f"/// é\npub fn {x}({', '.join(f'a: {y}' for y in r.sample(names, r.randrange(many + 1)))}) {{}}\n") for i, x in enumerate(names)]
        rows += [(f"hub{i}.rs", "rust", f"pub fn hub{i}({', '.join(names[i * 4 : i * 4 + 4])}) {{}}\n") for i in range(3)] + [("z.rs", "rust", f"fn {names[0]}() {{}}\nstruct {names[0]};\n")]
        c = CodeCorpus(files(spark, rows))
        nodes = {x.symbol_id: x for x in c.nodes.collect()}
        near = {i: {i} for i in nodes}
        for x in c.edges.collect():
            near[x.from_id].add(x.to_id)
            near[x.to_id].add(x.from_id)
        holder = {}
        for x in sorted(nodes.values(), key=lambda x: (x.file, x.pattern_ord, x.byte_start, x.symbol_id)):
            holder.setdefault(x.name, x.symbol_id)
        wanted = spark.createDataFrame([(x,) for x in [*holder, "missing", names[1]]] + [(None,)], "symbol string")
        for depth in (0, 1, 2, 3, 4):
            want = {"missing": ([], "", 0.0), None: ([], "", 0.0)}
            for name, i in holder.items():
                ball = {i}
                for _ in range(depth):
                    ball = set().union(*(near[x] for x in ball))
                listed = sorted((nodes[x] for x in ball), key=lambda x: (x.file, x.byte_start, x.name, x.kind))
                shown = {"Function": "fn", "Struct": "struct"}
                text = "\n".join(f"//{' > ' if x.symbol_id == i else '   '}{x.file} {shown[x.kind]} {x.name}" for x in listed) + "\n\n" + "\n".join(x.signature for x in listed)
                want[name] = ([x.name for x in listed], text, 85.0)
            for shared in (True, False):
                got = [(x.target_symbol, (x.included_symbols, x.sliced_code, x.token_reduction_percent)) for x in rewrite.slice_symbols(c, wanted, depth, shared, task_bytes).collect()]
                assert len(got) == len(want) and dict(got) == want
        c.unpersist()


def test_symbols_around_one_hub_make_rows_by_symbol_not_by_pair(spark):
    n = 400
    rows = [("hub.rs", "rust", "pub struct Hub;\n")] + [(f"u{i:03}.rs", "rust", f"pub fn use_{i:03}x(h: Hub) {{}}\n") for i in range(n)]
    c = CodeCorpus(files(spark, rows))
    out = rewrite.slice_symbols(c, c.nodes.selectExpr("name AS symbol"), 2)
    got = out.collect()
    assert len(got) == n + 1 and all(len(r.included_symbols) == n + 1 and r.sliced_code.count("// > ") == 1 for r in got)
    assert most_rows_of_a_join(spark, out) <= 3 * n
    c.unpersist()


def test_slices_come_from_tasks_of_bounded_text(spark):
    """A Parquet writer may hold what a task makes, so a task makes few texts however large they are."""
    from pyspark.sql import functions as F

    groups = {"aa": 90, "bb": 60, "cc": 30, "dd": 1}
    rows = [(f"{g}.rs", "rust", f"pub struct {g};\n") for g in groups] + [(f"{g}{i:02}.rs", "rust", f"pub fn {g}_{i:02}x(h: {g}) {{}}\n") for g, n in groups.items() for i in range(n)]
    c = CodeCorpus(files(spark, rows))
    wanted = c.nodes.selectExpr("name AS symbol")
    size = F.octet_length("included_symbols") + F.octet_length("sliced_code")
    want = None
    for task_bytes in (60_000, 900):
        for more in ({}, {"list_bytes": 0}):  # lists broadcast, then lists dealt out
            out = rewrite.slice_symbols(c, wanted, 2, task_bytes=task_bytes, separator="; ", **more)
            tasks = out.select(F.spark_partition_id().alias("p"), size.alias("n"), F.struct("target_symbol", "included_symbols", "sliced_code").alias("r")).collect()
            made = {}
            for x in tasks:
                made[x.p] = made.get(x.p, 0) + x.n
            assert max(made.values()) <= task_bytes + max(x.n for x in tasks)
            got = sorted(tuple(x.r) for x in tasks)
            want = want or got
            assert got == want and len(got) == len(rows) and all(len(names.split("; ")) == groups[s[:2]] + 1 and code.count(f"// > {s[:2]}") == 1 and f" {s}\n" in code for s, names, code in got)
    c.unpersist()


def test_neighbourhoods_within_others_equal_brute_force(spark):
    r = random.Random(3)
    dense = {(a, b) for a in range(40) for b in range(40) if a < b}
    for pairs in (dense, {(a, b) for a in range(25) for b in range(25) if a < b and r.random() < 0.2}, {(0, b) for b in range(1, 9)} | {(-1, 20)}):
        near = {}
        for a, b in pairs:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
        links = spark.createDataFrame(sorted(pairs | {(b, a) for a, b in pairs}), "here long, there long")
        found = {}
        for x in centres(links).collect():
            found.setdefault(x.here, set()).add(x.there)
        top = set().union(*found.values())
        assert {frozenset(near[x]) for x in top} == {frozenset(m) for m in near.values() if not any(m < o for o in near.values())} and len({frozenset(near[x]) for x in top}) == len(top)
        assert found == {x: near[x] & top for x in near}
    ids = ["0000000000000000", "ffffffffffffffff", "8000000000000000", "7fffffffffffffff", "00000000000000ff"]
    assert [x[0] for x in spark.createDataFrame([(i,) for i in ids], "i string").select(numbered("i")).collect()] == [0, -1, -(1 << 63), (1 << 63) - 1, 255]
