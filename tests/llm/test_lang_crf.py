from collections import Counter

import numpy as np

from codemosaic.llm import lang_crf
from codemosaic.llm.common import crc_of

from .conftest import SCHEMA, prose, row


def plain(scores, links):
    n, k = scores.shape
    a, b = np.zeros((n, k)), np.zeros((n, k))
    a[0] = scores[0]
    for t in range(1, n):
        a[t] = scores[t] + np.logaddexp.reduce(a[t - 1][:, None] + links, axis=0)
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(links + (scores[t + 1] + b[t + 1])[None, :], axis=1)
    z = np.logaddexp.reduce(a[-1])
    moved = sum((np.exp(a[t - 1][:, None] + links + (scores[t] + b[t])[None, :] - z) for t in range(1, n)), np.zeros((k, k)))
    return np.exp(a + b - z), moved, z


def test_forward_backward_equals_the_plain_recursion():
    r = np.random.default_rng(1)
    sizes = np.array([1, 2, 31, 32, 33, 64, 150])
    scores, links = r.normal(size=(sizes.sum(), 3)) * 3, r.normal(size=(3, 3)) * 2
    belief, moved, value = lang_crf.marginals(scores, sizes, links)
    parts = [plain(scores[e - s : e], links) for s, e in zip(sizes, np.cumsum(sizes), strict=True)]
    assert np.allclose(belief, np.concatenate([p[0] for p in parts])) and np.allclose(moved, sum(p[1] for p in parts)) and np.isclose(value, sum(p[2] for p in parts))


def test_words_of_a_switched_text():
    langs = ["en", "de", "fr"]
    model = lang_crf.fit([lang_crf.words(prose(i, 60, langs[i % 3])) for i in range(60)], [langs[i % 3] for i in range(60)])
    own = lang_crf.words(prose(500, 40, "de")) + lang_crf.words(prose(501, 40, "fr"))
    belief = lang_crf.marginals(model.unary(own), np.array([len(own)]), model.links)[0]
    said = [model.languages[i] for i in belief.argmax(axis=1)]
    assert np.mean(np.array(said[:40]) == "de") > 0.95 and np.mean(np.array(said[-40:]) == "fr") > 0.95


def test_gradient_equals_numeric_differences():
    texts = [(lang_crf.words(prose(i, 12, y)), y) for i, y in enumerate(("en", "de", "fr", "en"))]
    model = lang_crf.fit([t for t, _ in texts], [y for _, y in texts], rounds=3)
    parts = [(t, [y] * len(t)) for t, y in texts] + lang_crf.mixtures([t for t, _ in texts], [y for _, y in texts], 3)
    corpus = lang_crf.Corpus(model, parts, Counter(w for t, _ in parts for w in t))
    r = np.random.default_rng(2)
    for g, p in zip(corpus.gradient()[0], (model.grams, model.entries, model.links), strict=True):
        used = np.flatnonzero(np.abs(g) > 1e-5)
        for at in r.choice(used, min(12, len(used)), replace=False):
            kept, sides = p.flat[at], []
            for d in (1e-5, -1e-5):
                p.flat[at] = kept + d
                sides.append(corpus.gradient()[1])
            p.flat[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-5 - g.flat[at]) < 1e-6


def test_word_labels_of_switched_documents(spark):
    langs = ["en", "de", "fr"]
    docs = [row(i, prose(i, 60, langs[i % 3]), langs[i % 3]) for i in range(120)]
    model = lang_crf.train(spark.createDataFrame(docs, SCHEMA))
    right = []
    for i in range(20):
        a, b, c = (prose(900 + 3 * i + k, 15, y).split("\n")[0] for k, y in enumerate(langs))
        want = [y for text, y in zip((a, b, c), langs, strict=True) for _ in lang_crf.words(text)]
        got = lang_crf.label_words(spark.createDataFrame([row(1, f"{a} {b} {c}"), row(2, None), row(3, "½")], SCHEMA), model).collect() if i == 0 else None
        if got:
            assert [w.word for w in got[0].words] == lang_crf.words(f"{a} {b} {c}") and got[1].words == got[2].words == []
        belief = lang_crf.Tagger(model).beliefs([lang_crf.words(f"{a} {b} {c}")])[0]
        right += [model.languages[int(x.argmax())] == y for x, y in zip(belief, want, strict=True)]
    assert np.mean(right) > 0.93


def test_what_is_no_letter(spark):
    docs = spark.createDataFrame([row(100 + i, prose(i, 20), "en") for i in range(20)] + [row(1, "½ ²"), row(2, "Ⅳ 1"), row(3, "12 ½x²y")], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_crf.identify(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and lang_crf.words("12 ½x²y Ⅳ") == ["x", "y"]


def test_sample_takes_every_language(spark):
    rare = [row(5000 + i, prose(i, 9, "fr"), "fr") for i in range(8)]
    rows = [row(i % 7, prose(i % 7, 30), "en") for i in range(3000)] + [row(100 + i, prose(i, 30), "de") for i in range(400)] + rare
    got = [r.lang for r in lang_crf.sample(spark.createDataFrame(rows, SCHEMA), per_language=20).collect()]
    assert got.count("de") == 20 and got.count("fr") == sum(crc_of(5000 + i) % 4 != 2 for i in range(8)) and got.count("en") == sum(crc_of(i) % 4 != 2 for i in range(7))
    assert lang_crf.sample(spark.createDataFrame(rows, SCHEMA), chars=5).count() == 0


def test_identify(spark, edge_docs, edge_rows, no_docs):
    langs = ["en", "de", "fr"]
    docs = spark.createDataFrame([row(100 + i, prose(i, 50, langs[i % 3]), langs[i % 3]) for i in range(150)], SCHEMA).union(edge_docs)
    got = lang_crf.identify(docs).collect()
    assert len(got) == 150 + len(edge_rows) and all(r.held_out == (crc_of(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and (r.doc_id or 0) >= 100]
    assert np.mean([r.lang_pred == langs[(r.doc_id - 100) % 3] for r in held]) > 0.95
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 6)} == {("und", 0.0)}
    assert lang_crf.identify(no_docs).count() == 0


def test_without_training_rows(spark, edge_docs):
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in lang_crf.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Seventy languages, more than have a full sample each, and one whose first text by hash is huge."""
    rows = [row(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}x" for w in ("qa", "we", "ri")) + f" n{chr(97 + i % 26)}", f"l{k:02}") for i, k in enumerate(k for k in range(70) for _ in range(6))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len({r.lang for r in lang_crf.sample(docs).collect()}) == 70
    assert set(lang_crf.train(docs).languages) == {f"l{k:02}" for k in range(70)}
    huge = [row(i, "word " * (90_000 if i % 3 == 0 else 5), "en") for i in range(40)]
    assert lang_crf.sample(spark.createDataFrame(huge, SCHEMA)).count() >= 15
