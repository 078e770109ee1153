import numpy as np

from codemosaic.llm import quality_nbsvm as nbsvm
from codemosaic.llm.common import crc_of

from .conftest import SCHEMA, prose, row


def junk(seed):
    return " ".join(w + "***" for w in prose(seed, 80).split())


def labelled(spark, n=160):
    docs = spark.createDataFrame([row(i, junk(i) if i % 4 == 0 else prose(i, 80)) for i in range(n)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = nbsvm.score(docs, labels).collect()
    assert len(got) == 160 and all(r.held_out == (crc_of(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert sorted(nbsvm.score(docs, labels).collect()) == sorted(nbsvm.score(docs, wrong).collect())


def test_dual_coordinate_descent_meets_its_conditions():
    """Against the conditions of the optimum, and against a plain solver of the dual problem on the dense matrix."""
    r = np.random.default_rng(2)
    rows = [np.unique(np.concatenate([r.integers(0, 300, 20), r.integers(300, 340, 3) + 40 * (i % 2 if i % 7 else r.integers(0, 2))])).astype(np.int32) for i in range(80)]
    labels = np.arange(80) % 2
    sign, cost = np.where(labels == 1, 1.0, -1.0), np.where(labels == 1, 0.4, 0.6)
    ratios = nbsvm.log_ratios(rows, labels)
    values = nbsvm.scaled(rows, ratios)
    w, bias, alpha = nbsvm.descend(rows, values, sign, cost, epochs=3000)
    dense = np.zeros((80, nbsvm.SIZE))
    for i, (x, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, x] = v
    assert np.allclose(w, (alpha * sign) @ dense) and np.isclose(bias, alpha @ sign)
    margin = sign * (dense @ w + bias)
    assert (margin[alpha <= 1e-12] > 1 - 0.01).all() and (margin[alpha >= cost - 1e-12] < 1 + 0.01).all()
    assert (np.abs(margin[(alpha > 1e-12) & (alpha < cost - 1e-12)] - 1) < 0.01).all()
    q = (sign[:, None] * (dense @ dense.T + 1)) * sign
    plain, step = np.zeros(80), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        plain = np.clip(plain - step * (q @ plain - 1), 0, cost)
    value = lambda a: a.sum() - a @ q @ a / 2
    primal = (w @ w + bias**2) / 2 + (cost * np.maximum(0, 1 - margin)).sum()
    assert abs(value(alpha) - value(plain)) < 1e-3 * value(plain) and primal - value(plain) < 0.01 * value(plain)


def test_log_ratios_and_scores_by_hand():
    rows = [np.array(x, np.int32) for x in ([0, 1], [1, 2], [2], [0, 2])]
    labels = np.array([1, 1, 0, 0])
    ratios, size = nbsvm.log_ratios(rows, labels), nbsvm.SIZE
    for f in range(4):
        p, n = (1 + sum(f in r for r, y in zip(rows, labels, strict=True) if y == c) for c in (1, 0))
        assert np.isclose(ratios[f], np.log(p / (size + 4)) - np.log(n / (size + 3)))
    model = nbsvm.fit(rows * 6, np.tile(labels, 6))
    for r in rows:
        margin = sum(float(model.weights[f]) for f in r) / np.sqrt(sum(float(model.ratios_squared[f]) for f in r)) + model.bias
        assert np.isclose(model.score(r), 1 / (1 + np.exp(-(model.slope * margin + model.offset))))


def test_the_sample_is_bounded_in_bytes(spark):
    assert nbsvm.within([5, 3, 9, 2, 1], 10) == [0, 1, 3] and nbsvm.within([], 3) == []
    docs, labels = labelled(spark)
    model = nbsvm.train(docs, labels, sample_bytes=60_000)
    assert model.slope != 0 and not np.array_equal(model.weights, nbsvm.train(docs, labels).weights)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    _, labels = labelled(spark)
    none = labels.limit(0)
    got = nbsvm.score(edge_docs, none).collect()
    assert len(got) == len(edge_rows) and {round(r.score, 6) for r in got} == {0.5}
    assert nbsvm.score(no_docs, labels).count() == 0 and nbsvm.accepted(no_docs, labels).count() == 0
    docs, labels = labelled(spark)
    more = labels.unionByName(spark.createDataFrame([(1, None, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    kept = nbsvm.accepted(docs.union(edge_docs), more)
    assert kept.schema == edge_docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert not any(i is not None and i % 4 == 0 and i > 8 for i in ids) and ids.count(9) == 1
