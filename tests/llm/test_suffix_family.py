import hashlib
import random

import numpy as np
import pytest

from codemosaic.llm import suffix_family
from codemosaic.llm.queries import removal_digests

from .conftest import SCHEMA, prose, row


def brute(docs):
    """Rows of the contract, straight from the definition, of (doc_id, text) in order."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            x = data[s : s + 100]
            if x in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(x)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, docs, **more):
    return [tuple(x) for x in removal_digests(suffix_family.remove_repeats(spark.createDataFrame([row(*d) for d in docs], SCHEMA), **more)).collect()]


def made(seed, n):
    """Texts with shared passages of every length around 100 bytes, in changing surroundings."""
    r = random.Random(seed)
    pool = [prose(1000 + k, r.randint(8, 60), r.choice(["en", "de", "fr"])) for k in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(pool)
            a = r.randrange(max(1, len(p) // 2))
            parts.append(r.choice([prose(r.randrange(10**6), r.randint(1, 40)), p, p[a : a + r.randint(60, 220)], "ab" * r.randint(0, 120), "é" * r.randint(0, 90)]))
        docs.append((i, r.choice(["", " ", "\n"]).join(parts)))
    return docs


@pytest.mark.parametrize(("seed", "batches"), [(1, 3), (2, 1)])
def test_equals_brute_force(spark, seed, batches):
    docs = made(seed, 60)
    got = run(spark, docs, batches=batches)
    assert sorted(got) == brute(docs) and sum(x[2] for x in got) > 2000


def test_joins_by_shuffle(spark, monkeypatch):
    docs = made(5, 40)
    monkeypatch.setattr(suffix_family, "_few", lambda rows, _: rows)
    monkeypatch.setattr(suffix_family, "broadcast_if_few", lambda rows, _: rows)
    assert sorted(run(spark, docs, batches=2)) == brute(docs)


def test_pieces_of_a_long_text(monkeypatch):
    """Blocks of numpy's work change no decision: entries of all blocks cover each string once."""
    text = (prose(3, 900) + "x" * 300).encode()
    for piece in (150, 1000, 1 << 22):
        monkeypatch.setattr(suffix_family, "PIECE", piece)
        rows = zip(*(x.tolist() for x in suffix_family.Pieces([b"short", text, b"y" * 100]).entries()), strict=True)
        strings = sorted((d, at + k) for d, _, _, at, n, _ in rows for k in range(n))
        assert strings == [(1, s) for s in range(len(text) - 99)] + [(2, 0)]


def test_equal_strings_pick_equal_places():
    shared = prose(9, 40)[:100].encode()
    cores = set()
    for i in range(20):
        head = prose(i, 30).encode()
        _, core, _, at, n, _ = suffix_family.Pieces([head + shared + prose(50 + i, 30).encode()]).entries()
        cores |= {*core[(at <= len(head)) & (len(head) < at + n)].tolist()}
    assert len(cores) == 1


def test_levels_merge_geometrically(spark, monkeypatch):
    sizes = []
    scan = suffix_family.Levels.scan

    def spied(self, entries):
        sizes.append([n for _, _, n in self.tables])
        return scan(self, entries)

    monkeypatch.setattr(suffix_family.Levels, "scan", spied)
    docs = [(i, prose(i, 20)) for i in range(50)]
    run(spark, docs, batches=5)
    assert sizes[::5] == [[], [1], [2], [2, 1], [4]]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffixes_")]


def test_levels_decide(spark, monkeypatch):
    """A copy in a later batch is known from the levels alone."""
    docs = [(i, prose(i, 60)) for i in range(8)] + [(i + 50, prose(i, 60)) for i in range(8)]
    assert sum(x[2] > 0 for x in run(spark, docs, batches=2)) == 8
    monkeypatch.setattr(suffix_family.Levels, "_read", lambda self, name: self.spark.table(name).where("false").select("core", "whole", "own_id", "root"))
    assert sum(x[2] > 0 for x in run(spark, docs, batches=2)) == 0


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = [tuple(x) for x in removal_digests(suffix_family.remove_repeats(edge_docs)).collect()]
    assert len(got) == len(edge_rows)
    # A repeated row is one document, and null comes first.
    texts = sorted({(x[0], x[1]) for x in edge_rows if x[0] != 7}, key=lambda d: (d[0] is not None, d[0] or 0))
    expected = {x[0]: x for x in brute(texts)}
    assert all(x == expected[x[0]] for x in got if x[0] != 7)
    assert removal_digests(suffix_family.remove_repeats(no_docs)).count() == 0
    same = [(1, prose(1, 50)), (1, prose(2, 50) + prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50))]
    rows = run(spark, same)
    size = {len(prose(1, 50)): 0, len(prose(2, 50)): 0}
    both = [x for x in rows if x[1] == len(prose(1, 50).encode())]
    assert len(rows) == 4 and both[0] == both[1] and len(size) == 2
    lost = sum(x[2] for x in rows if x[0] == 1) - both[0][2]
    assert [x[2] for x in rows if x[0] == 2] == [len(prose(2, 50).encode())] and lost in (len(prose(1, 50).encode()), 0)
