import itertools
import random
import tracemalloc

import pytest

from codemosaic.llm import decontam_seeds as seeds

from .conftest import prose, row

ITEMS = [(i, prose(900 + i, n)) for i, n in enumerate([30, 13, 9, 5, 3, 60, 25, 25])]


def brute(items, text, least=seeds.LEAST_WORDS):
    doc, out = seeds.words(text or ""), {}
    for item, t in items:
        w = seeds.words(t or "")
        size = min(seeds.WINDOW, len(w))
        if len(w) < least:
            continue
        for d in range(-len(w) + 1, len(doc)):
            equal = [0 <= d + k < len(doc) and doc[d + k] == w[k] for k in range(len(w))]
            for s in range(len(w) - size + 1):
                share = sum(equal[s : s + size]) / size
                if sum(equal[s : s + size]) >= size - {9: 1, 13: 2}.get(size, 0):
                    out[item] = max(out.get(item, 0), share)
    return sorted(out.items())


def texts():
    r = random.Random(9)
    out = ["", None, "two words", ITEMS[0][1], ITEMS[5][1].upper()]
    for k in range(40):
        w = r.choice(ITEMS)[1].split()
        for p in range(len(w)):
            if r.random() < 0.17:
                w[p] = f"zz{p}"
        cut = r.choice([9, 13, 16, 99])
        out.append(" ".join([*prose(k, 30).split(), *w[:cut], *prose(k + 60, 20).split()]))
    return out


def test_equals_brute_force():
    table = seeds.SeedTable(ITEMS)
    found = table.overlaps([t or "" for t in texts()])
    expected = [brute(ITEMS, t) for t in texts()]
    assert [[i for i, _ in x] for x in found] == [[i for i, _ in x] for x in expected]
    assert all(abs(a - b) < 1e-9 for x, y in zip(found, expected, strict=True) for (_, a), (_, b) in zip(x, y, strict=True))
    assert sum(map(bool, found)) > 8


def test_short_items_match_whole():
    items = [(1, "one"), (2, "two words"), (3, "three words here"), (4, "four words are here"), (5, "these words are just five")]
    docs = ["one two words", "three words here four words are", "four words are here", "a b c", "these words are just five", "three words, here!"]
    table = seeds.SeedTable(items)
    assert table.overlaps(docs) == [brute(items, t, 1) for t in docs] and [len(x) for x in table.overlaps(docs)] == [2, 1, 1, 0, 1, 1]
    assert [len(x) for x in seeds.SeedTable(items, least_words=5).overlaps(docs)] == [0, 0, 0, 0, 1, 0]


def test_scripts_without_spaces():
    item = "これは日本語で書かれた長い試験の文章です"
    assert len(seeds.words(item)) == len(item) and seeds.words("Один two_3 日本 é") == ["один", "two_3", "日", "本", "é"]
    table = seeds.SeedTable([(1, item)])
    assert table.overlaps([f"前{item}後", item[:8], item.replace("長", "短")]) == [[(1, 1.0)], [], [(1, 12 / 13)]]


def test_memory_is_bounded_by_words_not_by_the_longest_item():
    r = random.Random(2)
    long, short = " ".join(f"w{r.randrange(9000)}" for _ in range(20_000)), [" ".join(f"w{r.randrange(9000)}" for _ in range(25)) for _ in range(2000)]
    tracemalloc.start()
    table = seeds.SeedTable([(0, long), *enumerate(short, 1)])
    docs = [long, " ".join(short[:500]), *short[:3]]
    found = table.overlaps(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and (0, 1.0) in found[0] and {i for i, _ in found[1]} >= {*range(1, 501)} and [(k, 1.0) in found[1 + k] for k in (1, 2, 3)] == [True] * 3


def test_a_phrase_that_many_items_share():
    items = [(i, f"the same five words here {prose(i, 9)}") for i in range(300)]
    docs = ["x the same five words here y " * 200, items[7][1]]
    found = seeds.SeedTable(items).overlaps(docs)
    assert found[0] == [] and found[1][0][0] == 7 and len(found[1]) == 1


@pytest.mark.parametrize("block_chars", [seeds.BLOCK_CHARS, 200])
def test_blocks_give_the_same(spark, block_chars):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, (99, None)], "item_id long, text string")
    got = seeds.find_overlaps(docs, items, 1, block_chars).collect()
    assert {r.c0: sorted(x.item_id for x in r.contaminated_by) for r in got} == {i: [k for k, _ in brute(ITEMS, t)] for i, t in enumerate(texts())}


def test_edges(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame([(1, edge_rows[0][1]), (2, "")], "item_id long, text string")
    kept = seeds.decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 3, 3, 4, 6, 7, 7, 8]  # 5 holds the passage too
    none = spark.createDataFrame([], "item_id long, text string")
    assert seeds.decontaminate(edge_docs, none).count() == len(edge_rows) and seeds.contamination(no_docs, items).count() == 0
    marked = seeds.contamination(edge_docs, items).collect()
    assert len(marked) == len(edge_rows) and sum(r.contaminated for r in marked) == 4
    assert seeds.decontaminate(spark.createDataFrame([row(1, "x")], edge_docs.schema), items).count() == 1


@pytest.mark.parametrize("size", range(seeds.MIN_WORDS, seeds.WINDOW + 1))
def test_masks_find_any_place(size):
    hit = lambda gone: any(all(s + o not in gone for o in offsets) for m, offsets in zip(seeds.MASKS, seeds._OFFSETS, strict=True) for s in range(size - len(m) + 1))
    assert all(hit(c) for c in itertools.combinations(range(size), size - seeds.needed(size)))
    assert seeds.needed(size) >= seeds.SHARE * size
