import random
import time

from codemosaic.operators import components, graph
from codemosaic.operators.graph import CodeCorpus


def table(spark, links):
    return spark.createDataFrame(links, "a string, b string")


def brute(links):
    """node -> smallest node of its component, of the nodes on cycles."""
    reach = {}
    for a in {a for a, _ in links}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for y in (b for c, b in links if c == x):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    return {a: min(b for b in r if a in reach.get(b, ())) for a, r in reach.items() if a in r}


def got(spark, links):
    return {r.node: r.component for r in components.strong_components(table(spark, links)).collect()}


def test_equals_reachability(spark):
    r = random.Random(2)
    for n, m in ((6, 8), (14, 18), (20, 60)):
        links = [(f"{k}{r.randrange(n):02}", f"{k}{r.randrange(n):02}") for k in "xyz" for _ in range(m)]
        assert got(spark, links) == brute(links)


def test_shapes(spark):
    rings = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)]
    shared = [("a3", "b1"), ("b1", "b2"), ("b2", "a3")]  # two rings that share a file
    tail = [("a0", "t1"), ("t1", "t2"), ("h1", "a5")]
    links = rings + shared + tail + [("s", "s"), ("p", "q"), ("q", "p"), ("q", "q")]
    want = dict.fromkeys([f"a{i}" for i in range(7)] + ["b1", "b2"], "a0") | {"s": "s", "p": "p", "q": "p"}
    assert got(spark, links) == want == brute(links)
    assert got(spark, []) == {}


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    links = [(f"c{i:05}", f"c{i + 1:05}") for i in range(n)]
    _, rounds = components._contracted(table(spark, links))
    assert len(rounds) < 40
    ring = links[:3000] + [("c03000", "c00000")]
    began = time.perf_counter()
    found = got(spark, ring)
    assert len(found) == 3001 and set(found.values()) == {"c00000"} and time.perf_counter() - began < 120


def corpus_of(spark, links):
    targets = {}
    for a, b in links:
        targets.setdefault(a, []).append(b)
        targets.setdefault(b, [])
    rows = [(f"{a}.ts", "typescript", "".join(f'import {{ x }} from "{b}.ts";\n' for b in bs)) for a, bs in targets.items()]
    return CodeCorpus(spark.createDataFrame(rows, "path string, language string, content string"))


def test_cycles_of_meshes(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    c = corpus_of(spark, links)
    cycles = sorted(tuple(x.removesuffix(".ts") for x in r.cycle) for r in c.import_cycles().collect())
    assert cycles == [("a", "b", "c", "a"), ("c", "d", "c"), ("r1", "r2", "r3", "r1"), ("x", "x")]
    assert {(r.component, r.n_files, r.n_links, r.kind) for r in c.cyclic_components().collect()} == {("a.ts", 4, 5, "mesh"), ("x.ts", 1, 1, "self"), ("r1.ts", 3, 3, "ring")}
    assert sorted(len(r.cycle) - 1 for r in c.import_cycles(most=2).collect()) == [1, 2]
    c.unpersist()


def test_dense_components_give_the_shortest_cycle_of_each_link(spark):
    n = 9  # all import all: far too many elementary cycles to list
    links = [(f"k{i}", f"k{j}") for i in range(n) for j in range(n) if i != j]
    c = corpus_of(spark, links)
    cycles = {tuple(r.cycle) for r in c.import_cycles().collect()}
    assert cycles == {(f"k{i}.ts", f"k{j}.ts", f"k{i}.ts") for i in range(n) for j in range(i + 1, n)}
    assert graph.CHOICES == 12
    c.unpersist()
