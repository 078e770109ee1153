import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codemosaic.llm import periodic_runs
from codemosaic.llm.queries import damaged_by_periods, run_digests

from .conftest import SCHEMA, prose, row


def brute(words, least=24, periods=3):
    """Runs straight from the definition: maximal stretches of each period, under the smallest period they have."""
    n, found = len(words), {}
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p - i), p)  # smaller periods come first
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = (None,) * 4
    for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])):
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p, 1000 * length // p)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def lists(found):
    return [[tuple(r) for r in f.tolist()] for f in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=5), min_size=1, max_size=4))
def test_equals_the_definition(texts):
    texts = [[x for unit, n in parts for x in unit * n] for parts in texts]
    assert lists(periodic_runs.runs_of([np.array(t, np.int64) for t in texts])) == [brute(t) for t in texts]


def test_other_limits_and_small_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 7)
    r = random.Random(5)
    for _ in range(200):
        t = [r.randrange(2) for _ in range(r.randint(0, 40))] + [1, 0, 0] * r.randint(0, 9)
        for least, periods in ((6, 3), (1, 3), (10, 4)):
            assert lists(periodic_runs.runs_of([np.array(t, np.int64)], least, periods)) == [brute(t, least, periods)]


def test_extensions():
    r = random.Random(1)
    for _ in range(60):
        t = [r.randrange(3) for _ in range(r.randint(1, 60))] * r.randint(1, 3)
        e = periodic_runs.Extensions(np.array([*t, 99]))
        assert sorted(range(len(t) + 1), key=lambda i: [*t, 99][i:]) == e.order.tolist()
        a, b = np.array([(x, y) for x in range(len(t)) for y in range(len(t)) if x != y] or [(0, len(t))]).T
        expected = [next(k for k in range(len(t) + 1) if max(x, y) + k >= len(t) or t[x + k] != t[y + k]) for x, y in zip(a, b, strict=True)]
        assert e.of(a, b).tolist() == expected


def test_query_equals_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        words = prose(i, r.randint(0, 70)).split()
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = words[at : at + r.randint(1, 9)] * r.randint(2, 14) or ["x"] * r.randint(0, 30)
        rows.append(row(i, r.choice([" ", "\n", "\t "]).join(words)))
    got = run_digests(periodic_runs.find_runs(damaged_by_periods(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert {tuple(x) for x in got} == {brute_row(x[0], x[1]) for x in rows}
    assert sum(x.n_runs > 0 for x in got) > 40


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = run_digests(periodic_runs.find_runs(damaged_by_periods(edge_docs))).collect()
    expected = {brute_row(x[0], x[1]) for x in edge_rows if len(x[1] or "") < 100_000}
    assert len(got) == len(edge_rows) and expected <= {tuple(x) for x in got}
    assert run_digests(periodic_runs.find_runs(damaged_by_periods(no_docs))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, 24, 2)


def test_long_texts():
    """Half a million words that all agree, and a long period, in seconds."""
    same = np.zeros(300_000, np.int64)
    assert lists(periodic_runs.runs_of([same])) == [[(0, 300_000, 1)]]
    unit = np.arange(40_000)
    assert lists(periodic_runs.runs_of([np.concatenate([[7], np.tile(unit, 4), [7]])])) == [[(1, 160_000, 40_000)]]
