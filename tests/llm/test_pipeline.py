import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from . import test_bpe_chunks, test_decontam_seeds, test_line_winnow, test_probminhash
from .conftest import prose, row


def junk(seed):
    return " ".join(w + "***" for w in prose(seed, 90).split())


def tables(spark, folder):
    """A small input: clean texts, junk, exact and near copies, a passage that many share, benchmark passages, empty and null texts."""
    passage, item = prose(4000, 59).replace("\n", " "), prose(5000, 30).replace("\n", " ")
    texts = {i: prose(i, 130) for i in range(30)} | {100 + i: junk(i) for i in range(20)}
    texts |= {200 + i: texts[i] for i in range(4)}  # exact copies
    texts |= {210 + i: test_probminhash.changed(texts[10 + i].replace("\n", " "), 1, i) for i in range(4)}  # near copies, line breaks apart
    texts |= {220 + i: prose(600 + i, 70) + "\n" + passage + "\n" + prose(700 + i, 70) for i in range(4)}
    texts |= {230 + i: prose(800 + i, 50).replace("\n", " ") + " " + item + " " + prose(900 + i, 50).replace("\n", " ") for i in range(3)}
    texts |= {300: "", 301: None}
    docs = [row(i, t)[:5] for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 120), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(6000, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, [(1, item), (2, prose(6000, 30))]


def test_equals_a_brute_force_version(spark, tmp_path):
    texts, items = tables(spark, str(tmp_path))
    kept = {i: t for i, t in texts.items() if not 100 <= i < 120}
    deduped = test_line_winnow.brute([(i, t or "") for i, t in kept.items()])
    docs = [(i, deduped[i]) for i in kept]
    one = [(i, dict(docs)[i]) for i, label in test_probminhash.brute(docs) if i == label]
    clean = {i: t for i, t in one if not test_decontam_seeds.brute(items, t)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: test_bpe_chunks.expected(tokenizer, t) for i, t in clean.items()}
    assert not {100, 201, 210, 230, 231, 232, 300, 301} & got.keys() and {0, 10, 220, 221} <= got.keys()
    assert got[200][0] == 0  # stands for all texts that line dedup emptied, and for those that were empty


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path, edge_docs):
    """Every stage, one after the other, on rows that repeat, have no doc_id, and carry columns the operators use themselves."""
    tables(spark, str(tmp_path))
    docs = edge_docs.unionByName(edge_docs)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == edge_docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = docs.collect()
    assert len({r.text for r in rows}) == len(rows) and all(r.score == r.own == r.node == "x" for r in rows)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r.doc_id or 0 for r in rows)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
