import itertools
import random
from collections import Counter

import numpy as np

from codemosaic.llm import probminhash
from codemosaic.llm.components import components

from .conftest import prose


def changed(text, n, seed):
    words = text.split()
    for p in random.Random(seed).sample(range(len(words)), n):
        words[p] = f"zz{seed}x{p}"
    return " ".join(words)


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def likeness(x, y):
    """The larger of plain and probability Jaccard similarity, by their definitions."""
    plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return plain if plain >= 0.8 or max(*x.values(), *y.values()) == 1 else max(plain, sum(1 / sum(max(x[u] / x[d], y[u] / y[d]) for u in x.keys() | y.keys()) for d in x.keys() & y.keys()))


def brute(docs):
    label = {i: i for i in range(len(docs))}
    sets = [bag(t or "") for _, t in docs]
    often = [max(s.values(), default=1) > 1 for s in sets]
    for a, b in itertools.combinations(range(len(docs)), 2):
        if (docs[a][1] or "") == (docs[b][1] or "") or (sets[a] and sets[b] and (len(both := sets[a].keys() & sets[b].keys()) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both)) or both and (often[a] or often[b]) and likeness(sets[a], sets[b]) >= 0.8)):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    low = {}
    for i, l in label.items():
        low[l] = min(low.get(l, 1 << 60), docs[i][0])
    return [(docs[i][0], low[l]) for i, l in label.items()]


def test_classes_equal_brute_force(spark):
    docs = [(i, prose(i, 150)) for i in range(12)]
    docs += [(100 + i, changed(docs[i % 4][1], 1 + i % 3, i)) for i in range(24)]  # near copies, some below the limit
    docs += [(200 + i, docs[5][1]) for i in range(30)] + [(300, ""), (301, None), (302, "a few words"), (303, "a few words")]
    got = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(docs))
    assert all(r.is_kept == (r.doc_id == r.class_id) for r in got)


def test_large_groups_come_out_whole(spark):
    base = prose(77, 200)
    docs = [(0, base)] + [(i, changed(base, 1, i)) for i in range(1, 150)] + [(1000 + i, prose(500 + i, 120)) for i in range(20)]
    got = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(docs))
    assert {r.class_id for r in got if r.doc_id < 1000} == {0} and all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_near_copies_within_a_shared_passage_are_all_found(spark):
    passage = prose(9, 339).replace("\n", " ")
    docs = [(i, f"{passage} {prose(1000 + i, 50)}") for i in range(400)]  # 0.77 to each other, so one passage fills the buckets
    docs += [(5000 + i, changed(docs[3 * i][1], 7, i)) for i in range(130)]  # 0.83 to their own, less to the others
    got = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(docs))


def test_a_tree_of_near_copies_comes_out_whole(spark):
    docs = [(0, prose(41, 150).replace("\n", " "))]
    for i in range(1, 250):  # each a copy of an earlier one, so that most are linked to few others
        docs.append((i, changed(docs[(i - 1) // 3][1], 2, i)))
    got = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(brute(docs))


def test_texts_that_repeat_shingles(spark):
    docs = []
    for i in range(25):
        words = prose(60 + i, 200).split()
        docs += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words + words[-10:] * 30))]  # plain similarity 0.98, by counts far less
        said = " ".join(words[:20] * 40)  # most of the weight, so alike by counts alone
        docs += [(10 * i + 2, f"{said} {prose(900 + i, 30)}"), (10 * i + 3, f"{said} {prose(950 + i, 30)}")]
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(brute(docs))
    assert all(got[10 * i + 1] == 10 * i and got[10 * i + 3] == 10 * i + 2 != got[10 * i] for i in range(25))


def test_recall_at_edit_rates(spark):
    """Of near copies whose similarity reaches the limit, at three rates of changed words, nearly all are linked."""
    docs, pairs = [], []
    for rate in (0.005, 0.01, 0.02):
        for i in range(60):
            k = len(docs)
            base = prose(20_000 + k, 300).replace("\n", " ")
            docs += [(k, base), (k + 1, changed(base, int(300 * rate), k))]
            if likeness(bag(docs[k][1]), bag(docs[k + 1][1])) >= 0.8:
                pairs.append(k)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 120 and np.mean([got[k] == got[k + 1] for k in pairs]) >= 0.98


def test_one_row_of_repeated_ones_stands_for_the_class(spark):
    text = prose(3, 100)
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (1, text, "b"), (2, text, "c"), (2, "other", "d")], "doc_id long, text string, lang string").repartition(3)
    assert sorted((r.doc_id, r.class_id, r.is_kept) for r in probminhash.near_duplicates(docs).collect()) == [(1, 1, False), (1, 1, False), (1, 1, True), (2, 1, False), (2, 2, True)]
    kept = [sorted((r.doc_id, r.lang) for r in probminhash.one_of_each(docs.repartition(n)).collect()) for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 2 and kept[0][0][0] == 1 and kept[0][1] == (2, "d")


def test_blocks_compare_as_pairs_do():
    r = np.random.default_rng(4)
    bags = []
    for k in range(40):
        ids = np.sort(r.choice(np.arange(120 + k % 3), 100, replace=False)).astype(np.uint64)
        bags.append((ids.tobytes(), b"" if k % 2 else r.integers(1, 3 + 40 * (k % 4 == 0), 100).astype(np.uint32).tobytes()))
    assert (probminhash.linked(bags[:25], bags[10:]) == [[probminhash.similarity(*a, *b) >= 0.8 for b in bags[10:]] for a in bags[:25]]).all()


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    for shared, only in ((40, 10), (60, 60), (100, 5)):
        ids = r.integers(1, 1 << 62, shared + 2 * only, dtype=np.uint64)
        a, b = np.concatenate([ids[:shared], ids[shared : shared + only]]), np.concatenate([ids[:shared], ids[shared + only :]])
        wa, wb = r.integers(1, 4, len(a)), r.integers(1, 4, len(b))
        wb[:shared] = wa[:shared]
        est = np.mean([(x == y).mean() for k in range(12) for x, y in [probminhash.registers([a + np.uint64(k), b + np.uint64(k)], [wa, wb])]])
        order_a, order_b = np.argsort(a), np.argsort(b)
        pack = lambda x, o: x[o].tobytes()
        counts = lambda w, o: w[o].astype(np.uint32).tobytes()
        true = probability_jaccard(a, wa, b, wb)
        exact = probminhash.similarity(pack(a, order_a), counts(wa, order_a), pack(b, order_b), counts(wb, order_b))
        plain = shared / (shared + 2 * only)
        assert abs(est - true) < 0.05 and abs(exact - (plain if plain >= 0.8 else max(true, plain))) < 1e-9


def probability_jaccard(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa.tolist(), strict=True)), dict(zip(b.tolist(), wb.tolist(), strict=True))
    return sum(1 / sum(max(x.get(u, 0) / x[d], y.get(u, 0) / y[d]) for u in {*x, *y}) for d in x.keys() & y.keys())


def test_edges(spark, edge_docs, edge_rows, no_docs):
    kept = probminhash.one_of_each(edge_docs)
    assert kept.schema == edge_docs.schema
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # repeated rows leave one; the class of a text that also has a null doc_id keeps its smallest doc_id; null and empty texts are one class
    texts = [t for _, t in rows]
    assert texts.count(edge_rows[0][1]) == 1 and (1, edge_rows[0][1]) in rows
    assert len([t for t in texts if not (t or "").strip()]) == 2  # the class of empty texts, and the text of white space alone
    assert {d for d, _ in rows} >= {4, 5, 7, 8}
    assert probminhash.one_of_each(no_docs).count() == 0 and probminhash.near_duplicates(no_docs).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {got[0]} and {got[i] for i in range(100, 130)} == {got[100]} and got[200] == got[201]
    assert len({got[0], got[100], got[200]}) == 3 and components(spark.createDataFrame([], "a long, b long")).count() == 0
