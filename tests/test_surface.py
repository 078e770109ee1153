import io
import json

import pytest

from codemosaic import cli, rpc
from codemosaic.api import Engine
from codemosaic.sources import code_files
from codemosaic.streaming import guard_stream


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.fixture
def tree(tmp_path):
    texts = {
        "src/lib.rs": "/// Holds.\npub struct Store { n: u8 }\n\npub fn open_store(s: Store) -> u8 { s.n }\n", "src/use.rs": "use crate::Store;\nfn go(s: Store) {}\n", "pkg/__init__.py": "def start(x):\n    return x\n",
        "_top.py": "x = 1\n", "node_modules/a.js": "function no() {}\n", ".git/b.rs": "fn no() {}\n", "build": "no", "dist/c.ts": "function no() {}\n", "readme.txt": "text",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.rs").write_bytes(b"fn \xff() {}")
    return tmp_path


KEPT = {"src/lib.rs": "rust", "src/use.rs": "rust", "pkg/__init__.py": "python", "_top.py": "python"}


def test_directory(spark, tree):
    got = code_files.from_directory(spark, str(tree)).collect()
    assert {r.path: r.language for r in got} == KEPT and all(r.n_bytes == len(r.content.encode()) and len(r.content_hash) == 64 for r in got)
    binary = code_files.from_binary_files(spark, str(tree)).collect()
    assert {r.path: r.language for r in binary} == {p: x for p, x in KEPT.items() if "/_" not in p and not p.startswith("_")}


def test_parquet(spark, tree, tmp_path):
    code_files.write_parquet(code_files.from_directory(spark, str(tree)), str(tmp_path / "out.parquet"))
    back = code_files.from_parquet(spark, str(tmp_path / "out.parquet")).where("language = 'rust'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(language" in back._jdf.queryExecution().toString()


def ask(engine, method, number=1, **params):
    out = rpc.handle(rpc.Tools(engine), json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params}))
    return out and json.loads(out)


def tool(engine, name, **arguments):
    result = ask(engine, "tools/call", name=name, arguments=arguments)["result"]
    text = result["content"][0]["text"]
    try:
        return json.loads(text), result.get("isError", False)
    except ValueError:
        return text, result.get("isError", False)


def test_rpc_protocol(engine):
    assert ask(engine, "initialize")["result"]["protocolVersion"] == "2024-11-05" and ask(engine, "ping")["result"] == {}
    assert len(ask(engine, "tools/list")["result"]["tools"]) == 12 and ask(engine, "nothing")["error"]["code"] == -32601
    assert ask(engine, "nothing", None) is None and ask(engine, "initialized", None) is None and ask(engine, "initialized") == {"jsonrpc": "2.0", "id": 1, "result": {}}
    assert ask(engine, "ping", None) == {"jsonrpc": "2.0", "id": None, "result": {}}
    for raw in ("{", "[]", '{"id": 1}', '{"method": 3}'):
        assert json.loads(rpc.handle(rpc.Tools(engine), raw))["error"]["code"] == -32700
    out = io.StringIO()
    rpc.serve(engine, io.StringIO('\n{"id": 1, "method": "ping"}\n  \n{"method": "initialized"}\n{"id": 2, "method": "ping"}\n'), out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2]


def test_rpc_tools_on_text(engine):
    assert tool(engine, "check_safety", code="fn f(a: u8, b: u8) -> u8 { a / b }")[0]["violation"] == "DIV_BY_ZERO" and tool(engine, "check_safety")[1] and tool(engine, "none")[1]
    assert tool(engine, "skeletonize", code="fn a() { 1 }")[0] == "fn a();\n" and tool(engine, "skeletonize", code=3)[1]
    assert tool(engine, "patch_symbol", source="fn a() { 1 }", symbol="a", new_code="fn b() {}") == ("fn b() {}", False)
    assert tool(engine, "patch_symbol", source="fn a() { 1 }", symbol="z", new_code="fn b() {}")[1]
    made, _ = tool(engine, "synthesize_contract", intent="calculate user stats")
    assert made["primary_symbol"] == "user_stats"
    assert tool(engine, "verify_contract", generated_code="// user_stats UserStatsRequest UserStatsResponse UserStatsError", contract=made)[0]["passed"]
    assert not tool(engine, "verify_contract", generated_code="fn x() {}", intent="calculate user stats")[0]["passed"] and not tool(engine, "verify_contract", generated_code="")[0]["passed"]
    assert tool(engine, "extract_intent_slice", symbol="a", code="fn a() { 1 }")[0]["included_symbols"] == ["a"] and tool(engine, "extract_intent_slice", symbol="a")[1]


def test_rpc_tools_on_files(engine, tree):
    graph, _ = tool(engine, "index_graph", path=str(tree))
    assert (graph["file_count"], graph["symbol_count"]) == (4, 4) and {s["name"] for s in graph["symbols"]} == {"Store", "open_store", "go", "start"}
    found, _ = tool(engine, "resolve_symbol", symbol="Store", target_path=str(tree))
    assert found["doc_comment"] == "/// Holds." and found["is_exported"] and tool(engine, "resolve_symbol", symbol="no", target_path=str(tree))[0] is None
    assert tool(engine, "get_blast_radius", symbol="Store", path=str(tree))[0]["affected_files"] == ["src/lib.rs", "src/use.rs"]
    assert [(r["file"], r["line"]) for r in tool(engine, "find_references", symbol="Store", target_path=str(tree))[0]] == [("src/lib.rs", 2), ("src/lib.rs", 4), ("src/use.rs", 1), ("src/use.rs", 2)]
    assert tool(engine, "extract_intent_slice", symbol="Store", path=str(tree))[0]["included_symbols"][0] == "Store"
    lib = str(tree / "src/lib.rs")
    assert tool(engine, "extract_intent_slice", symbol="Store", path=lib)[0]["included_symbols"] == ["Store"]
    context, _ = tool(engine, "prepare_context", target_file=lib, symbol="Store")
    assert context["language"] == "rust" and context["blast_radius"]["symbol"] == "Store" and context["resolved_symbol"]["name"] == "Store" and tool(engine, "prepare_context", target_file="/none.rs")[1]
    assert tool(engine, "prepare_context", target_file=lib)[0]["blast_radius"] is None


def test_verified_patch_writes(engine, tree):
    lib = tree / "src/lib.rs"
    before = lib.read_text()
    assert tool(engine, "verified_patch", file_path=str(lib), symbol="open_store", new_code="fn a( {")[0]["stage"] == "pre_patch_safety_verification"
    assert tool(engine, "verified_patch", file_path=str(lib), symbol="none", new_code="fn a() {}")[0]["stage"] == "ast_patch_execution"
    done, failed = tool(engine, "verified_patch", file_path=str(lib), symbol="open_store", new_code="pub fn open_store() {}", dry_run=True)
    assert done["success"] and not failed and not done["written_to_disk"] and lib.read_text() == before
    assert tool(engine, "verified_patch", file_path=str(lib), symbol="open_store", new_code="pub fn open_store() {}")[0]["written_to_disk"]
    assert lib.read_text() == "/// Holds.\npub struct Store { n: u8 }\npub fn open_store() {}\n"


def test_commands(engine, tree, capsys):
    lib = str(tree / "src/lib.rs")
    run = lambda *a: (cli.main(list(a), engine), capsys.readouterr().out)
    assert run("check", lib) == (0, "passed\n") and run("check", "/none.rs")[0] == 1
    (tree / "x.rs").write_text("fn f(a: u8, b: u8) -> u8 { a / b }")
    assert run("check", str(tree / "x.rs"))[0] == 2
    assert "pub struct Store;" in run("skeleton", lib)[1] and "user_stats" in run("contract", "calculate user stats")[1]
    assert "pub struct Store" in run("slice", "Store", lib)[1] and "files 5" in run("graph", str(tree))[1]
    assert "MEDIUM" in run("impact", "Store", str(tree))[1] and run("refs", "Store", str(tree))[1].startswith("4 references")
    assert run("patch", lib, "--symbol", "open_store", "--with", "fn new() {}")[0] == 0 and "fn new() {}" in (tree / "src/lib.rs").read_text()
    assert run("patch", lib, "--symbol", "none", "--with", "x")[0] == 1


def test_streams(spark, tmp_path):
    rows = [("a", "rust", "fn f(a: u8, b: u8) -> u8 { a / b }"), ("b", "rust", "fn f() {}")]
    spark.createDataFrame(rows, guard_stream.FILES).write.parquet(str(tmp_path / "in"))
    query = guard_stream.start(guard_stream.verified_stream(guard_stream.file_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {r.path: r.violation for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "DIV_BY_ZERO", "b": None}


def test_cache_stream_equals_replay(spark, tmp_path):
    from codemosaic.operators.cache import replay

    schema = "cache_id string, seq long, op string, content string"
    rows = [(c, i, "get" if (i * 7 + len(c)) % 3 == 0 else "insert", f"t{(i * 5) % 11}") for c in ("x", "yy") for i in range(40)]
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = guard_stream.cache_stream(stream, 4).writeStream.format("memory").queryName("cache_log").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    key = lambda r: (r.cache_id, r.seq)
    got = sorted(spark.table("cache_log").collect(), key=key)
    want = sorted(replay(spark.createDataFrame(rows, schema), 4).collect(), key=key)
    assert [(r.cache_id, r.seq, r.hit, r.evicted, r.n_entries) for r in got] == [(r.cache_id, r.seq, r.hit, r.evicted, r.n_entries) for r in want]
