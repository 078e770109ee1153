import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codemosaic.llm.common import scratch_path
from codemosaic.llm.token_rollups import RollupStore, changes, count_tokens, signed

FEED = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def totals(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def brute(rows):
    out = defaultdict(lambda: [0, 0])
    for op, source, lang, version, n, old in rows:
        sign = {"insert": 1, "delete": -1, "revise": 0}[op]
        out[source, lang, version][0] += sign
        out[source, lang, version][1] += sign * (n or 0) if sign else (n or 0) - (old or 0)
    return {k: tuple(v) for k, v in out.items() if any(v)}


def test_batches_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice(["insert", "insert", "delete", "revise"]), r.choice(["hot", "hot", "a", None]), r.choice(["en", None]), "v1", r.choice([None, 5, 70]), r.choice([None, 3])) for _ in range(300)]
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    assert totals(store) == {}
    for k in range(3):
        assert store.commit(f"b{k}", spark.createDataFrame(rows[k * 100 : k * 100 + 100], FEED))
        assert not store.commit(f"b{k}", spark.createDataFrame(rows, FEED))  # sent again: refused
    assert totals(store) == brute(rows)
    store.compact()
    assert totals(store) == brute(rows) and not store.commit("b1", spark.createDataFrame(rows, FEED))
    assert store.commit("b3", spark.createDataFrame(rows[:7], FEED)) and totals(store) == brute(rows + rows[:7])
    store.compact()
    assert totals(store) == brute(rows + rows[:7]) and all(store.is_committed(f"b{k}") for k in range(4))


def test_failed_batch_leaves_nothing(spark):
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    with pytest.raises(Exception, match="unknown operation"):
        store.commit("bad", spark.createDataFrame([("upsert", "a", "en", "v1", 1, None)], FEED))
    assert totals(store) == {} and store.commit("bad", spark.createDataFrame([("insert", "a", "en", "v1", 1, None)], FEED))
    assert store.commit("empty", spark.createDataFrame([], FEED)) and totals(store) == {("a", "en", "v1"): (1, 1)}


def test_commits_and_compactions_between_each_other(spark, monkeypatch):
    """Whatever commits or compacts while a compaction or a reader is at work, a batch counts once."""
    feed = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, None)], FEED)
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    plain = RollupStore._sums
    store.commit("one", feed(5))

    def slow(self, names, base):
        monkeypatch.setattr(RollupStore, "_sums", plain)
        store.commit("two", feed(10))
        return plain(self, names, base)

    monkeypatch.setattr(RollupStore, "_sums", slow)
    assert store.compact() and totals(store) == {("a", "en", "v1"): (2, 15)}

    def overtaken(self, names, base):
        monkeypatch.setattr(RollupStore, "_sums", plain)
        assert store.compact() and store.commit("three", feed(20))
        return plain(self, names, base)

    monkeypatch.setattr(RollupStore, "_sums", overtaken)
    assert not store.compact() and store._names("staging") == []  # the loser leaves nothing
    assert totals(store) == {("a", "en", "v1"): (3, 35)}
    listed = store.totals()
    assert store.compact() and [tuple(r) for r in listed.collect()] == [("a", "en", "v1", 3, 35)]  # what was listed is still there
    assert store.commit("four", feed(1)) and store.compact() and store.compact()
    assert totals(store) == {("a", "en", "v1"): (4, 36)} and store._names("deltas") == [] and not store.commit("one", feed(5))

    def removed(self, names, base):
        monkeypatch.setattr(RollupStore, "_sums", plain)
        out = plain(self, names, base)
        assert all(store.compact() for _ in range(2))
        return out

    monkeypatch.setattr(RollupStore, "_sums", removed)
    assert store.read(lambda t: t.collect())[0].n_tokens == 36


def test_counts_of_documents(spark, edge_docs, edge_rows, no_docs):
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    counted = count_tokens(edge_docs, PATH)
    tokenizer = Tokenizer.from_file(PATH)
    rows = []
    for k, (version, now, old) in enumerate((("bpe@1", "bpe", "words"), ("words@1", "words", "bpe"))):
        store.commit(f"in {k}", changes(counted, "insert", version, old))
        store.commit(f"revised {k}", changes(counted, "revise", version, now, old))
        rows += [("insert", x[3], x[2], version, len(tokenizer.encode(x[1] or "").ids) if k == 0 else len((x[1] or "").encode().split()), None) for x in edge_rows]
    store.commit("draft", changes(counted, "insert", "draft", "bpe"))
    store.commit("draft out", changes(counted, "delete", "draft", "bpe"))
    assert totals(store) == brute(rows)
    none = changes(count_tokens(no_docs, PATH), "insert", "bpe@1", "bpe")
    assert signed(none).count() == 0 and store.commit("none", none) and totals(store) == brute(rows)
