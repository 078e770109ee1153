import random

import pytest

from codemosaic.operators.graph import CodeCorpus
from codemosaic.operators.index import CorpusIndex

FILES = "path string, language string, content string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def content(r, k):
    names = ["alpha", "beta", "al", "gamma$", "$", "run"]
    if k % 2:
        return "".join(f'import {{ x }} from "f{r.randrange(6)}.ts";\n' for _ in range(r.randint(0, 2))) + "".join(f"// doc\nexport function {r.choice(names)}(a: {r.choice(names)}) {{ return {r.choice(names)} }}\n" for _ in range(r.randint(0, 3)))
    return "".join(f"/// Says.\npub fn {n}(x: {r.choice(names[:3])}) {{ {r.choice(names)}() }}\nuse a::f{r.randrange(4)};\n" for n in r.sample(names[:3], r.randint(0, 3)))


def equal_to_a_rebuild(index, state, spark):
    whole = CodeCorpus(spark.createDataFrame([(p, lang, c) for p, (lang, c) in state.items()], FILES))
    node = ("symbol_id", "name", "kind", "file", "byte_start", "byte_end", "signature", "pattern_ord", "doc_comment")
    assert rows(index.read("nodes"), *node) == rows(whole.nodes, *node)
    assert rows(index.edges(), "from_id", "to_id", "edge_type") == rows(whole.edges, "from_id", "to_id", "edge_type")
    said = ("symbol", "file", "line", "byte_offset", "context_snippet")
    assert rows(index.read("references"), *said) == rows(whole.references, *said)
    assert rows(index.read("imports"), "file", "ord", "target") == rows(whole.imports, "file", "ord", "target")
    assert rows(index.read("files"), "file", "language") == sorted(((p, lang) for p, (lang, _) in state.items()), key=repr)
    whole.unpersist()


@pytest.mark.parametrize("seed", [1, 2])
def test_upserts_equal_a_rebuild(spark, tmp_path, seed):
    r, state, index = random.Random(seed), {}, CorpusIndex(spark, str(tmp_path / "index"))
    for step in range(4):
        change = {}
        for _ in range(r.randint(1, 4)):
            k = r.randrange(6)
            change[f"f{k}.ts" if k % 2 else f"src/f{k}.rs"] = None if step and r.random() < 0.3 else ("typescript" if k % 2 else "rust", content(r, k))
        index.upsert(spark.createDataFrame([(p, *(c or (None, None))) for p, c in change.items()], FILES))
        state |= {p: c for p, c in change.items() if c}
        for p in (p for p, c in change.items() if not c):
            state.pop(p, None)
        if step == 2:
            index.compact()
        equal_to_a_rebuild(index, state, spark)


def test_a_change_reads_its_own_files_only(spark, tmp_path):
    index = CorpusIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(f"f{i}.rs", "rust", f"pub fn f{i}() {{ g() }}\n") for i in range(20)], FILES))
    before = index.versions()
    index.upsert(spark.createDataFrame([("f3.rs", "rust", "pub fn f3() { g() }\n")], FILES))  # as it is
    index.remove(spark.createDataFrame([("none.rs",)], "path string"))
    assert index.versions() == before == [1]
    index.upsert(spark.createDataFrame([("f3.rs", "rust", "pub fn g() {}\n")], FILES))
    assert index.versions() == [1, 2]
    delta = {t: spark.read.parquet(f"{tmp_path}/index/{t}/2") for t in ("nodes", "words", "references", "within")}
    assert {x.file for t in ("nodes", "words") for x in delta[t].select("file").distinct().collect()} == {"f3.rs"}
    # The name g is new: lines of all files that say it are references now, by the words that are kept.
    assert index.read("references").where("symbol = 'g'").count() == 20 and index.read("references").where("symbol = 'f3'").count() == 0
    corpus = index.corpus()
    assert corpus.impact("g", None, 1).first().reference_count == 20
    assert [x.orphan for x in corpus.orphan_exports().where("orphan LIKE 'g %'").collect()] == []


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    index = CorpusIndex(spark, str(tmp_path / "index"))
    assert index.read("nodes").count() == 0 and index.edges().count() == 0
    index.upsert(spark.createDataFrame([("a.rs", "rust", "fn a() {}\n")], FILES))
    spark.read.parquet(f"{tmp_path}/index/nodes/1").write.parquet(f"{tmp_path}/index/nodes/2")  # a change that failed before its marker
    assert index.read("nodes").count() == 1
    index.upsert(spark.createDataFrame([("b.rs", "rust", "fn b() {}\n")], FILES))
    assert index.read("nodes").count() == 2
    with pytest.raises(Exception, match="exist"):
        index._commit(2, False)
