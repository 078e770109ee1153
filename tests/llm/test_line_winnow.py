import random

from codemosaic.llm import line_winnow

from .conftest import SCHEMA, prose, row


def brute(docs):
    """Lines deleted, straight from the definition: those within a run of 50 words or more that stands earlier."""
    texts = {d: t.split("\n") for d, t in docs}
    places = {}
    for d in sorted(texts):
        lines = texts[d]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = tuple(lines[i : j + 1])
                if sum(len(x.split()) for x in run) >= 50:
                    places.setdefault(run, []).append((d, i))
    gone = {d: set() for d in texts}
    for run, at in places.items():
        for d, i in sorted(at)[1:]:
            gone[d].update(range(i, i + len(run)))
    return {d: "\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, lines in texts.items()}


def test_equals_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(f"w{k}{i}" for i in range(n)) for k, n in enumerate([3, 8, 20, 30, 55, 70, 0, 12, 25, 60])]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for d in range(40)]
    got = line_winnow.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == brute(docs)
    assert all(x.n_lines == dict(docs)[x.doc_id].count("\n") + 1 and 0 <= x.n_removed <= x.n_lines for x in got)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = line_winnow.dedup_lines_stage(edge_docs)
    assert got.columns == edge_docs.columns and got.schema == edge_docs.schema
    rows = got.collect()
    assert len(rows) == len(edge_rows)
    text = sorted(((x.doc_id, x.text) for x in rows), key=repr)
    # null doc_id comes first in the order, so its text stays and those equal to it lose all their lines
    assert (None, prose(1, 120)) in text and text.count((1, "")) == 2
    assert (2, None) in text and text.count((3, "")) == 2 and (6, " \n\t\n ") in text
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in rows)
    assert line_winnow.dedup_lines_stage(no_docs).count() == 0 and line_winnow.dedup_lines(no_docs).count() == 0


def test_short_repeats_stay(spark):
    licence = "Licensed under some licence, version 2."
    docs = spark.createDataFrame([row(i, licence + "\n" + prose(i, 80)) for i in range(5)], SCHEMA)
    assert all(x.text.startswith(licence) and x.n_removed == 0 for x in line_winnow.dedup_lines(docs).collect())


def test_fingerprints_are_guaranteed():
    run = [" ".join(f"r{i}{k}" for k in range(9)) for i in range(7)]
    marks = []
    for seed in range(6):
        text = "\n".join([prose(seed, 70), *run, prose(seed + 50, 70)])
        marks.append({m for m, _ in line_winnow.Lines(text.encode()).fingerprints()})
    assert set.intersection(*marks)


def test_only_joined_positions_are_extended(spark, monkeypatch):
    run = "\n".join(" ".join(f"r{i}{k}" for k in range(9)) for i in range(7))
    docs = spark.createDataFrame([row(i, f"{prose(i, 70)}\n{run}\n{prose(i + 50, 70)}") for i in range(4)], SCHEMA)
    positions = {r.own_id: r.positions for r in line_winnow.joined_positions(docs).collect()}
    assert positions.keys() == {0, 1, 2, 3}
    for i, own in positions.items():  # every joined position lies in the run, and no other line is looked at
        lines = line_winnow.Lines(docs.where(f"doc_id = {i}").first().text.encode())
        assert all(lines.lines[p].startswith(b"r") for p in own) and len(own) < len(lines.fingerprints())
    assert sum(r.n_removed for r in line_winnow.dedup_lines(docs).collect()) == 21
    none = spark.createDataFrame([], "own_id long, own_hash long, positions array<int>")
    monkeypatch.setattr(line_winnow, "joined_positions", lambda *_: none)
    assert sum(r.n_removed for r in line_winnow.dedup_lines(docs).collect()) == 0


def test_positions_and_deletions_too_many_to_send(spark, monkeypatch):
    r = random.Random(8)
    pool = [" ".join(f"w{k}{i}" for i in range(n)) for k, n in enumerate([3, 30, 55, 70, 25])]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for d in range(20)]
    monkeypatch.setattr(line_winnow, "broadcast_if_few", lambda rows, name: rows)
    assert {x.doc_id: x.text for x in line_winnow.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == brute(docs)
