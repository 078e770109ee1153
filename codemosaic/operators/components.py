"""Strongly connected components of a link table, in rounds that halve chains.

Each round drops nodes that nothing links to or that link to nothing (no cycle holds them) and bypasses nodes with one link
in and one out: of such neighbours the one with the higher random number goes, and its two links become one. A bypassed
node lies in the component of its neighbours if these share one, else in none. So chains and rings of n nodes are gone
after about log n rounds; what is left, where paths meet and part, is coloured: the largest name that reaches a node is its
colour, and what reaches back to that name within a colour is a component.

Rows stay in tables; the driver counts them and holds the list of rounds. Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links (a, b) whose ends are not among gone(node)."""
    left = links.join(gone.select(F.col("node").alias("a")), "a", "left_anti")
    return left.join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")


def _contracted(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of links (no self-links) when nothing can be dropped or bypassed, and the bypassed nodes (node, before, after) of
    each round."""
    rounds: list[DataFrame] = []
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("after"), F.lit(None).cast("string").alias("before"))
        ends = ends.union(links.select(F.col("b").alias("node"), F.lit(None).cast("string"), F.col("a")))
        degrees = ends.groupBy("node").agg(F.count("after").alias("n_out"), F.count("before").alias("n_in"), F.min("after").alias("after"), F.min("before").alias("before"))
        # A number for each node and round; ties go by name.
        luck = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))), c)
        marked = degrees.where("n_in = 0 OR n_out = 0 OR (n_in = 1 AND n_out = 1)").withColumn("thin", F.expr("n_in = 1 AND n_out = 1"))
        thin = marked.where("thin").select("node", "before", "after")
        beaten = thin.select(F.explode(F.array(F.struct(F.col("before").alias("x"), F.col("node").alias("by")), F.struct(F.col("after").alias("x"), F.col("node").alias("by"))))).select("col.*")
        beaten = beaten.where(luck(F.col("by")) > luck(F.col("x"))).select(F.col("x").alias("node")).distinct()
        passed = thin.join(beaten, "node", "left_anti")
        gone = cut_lineage(marked.where("NOT thin").select("node", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")).union(passed))
        if gone.isEmpty():
            return links, rounds
        rounds.append(gone.where("before IS NOT NULL"))
        short = rounds[-1].where("before <> after").select(F.col("before").alias("a"), F.col("after").alias("b"))
        # A node that is dropped in the same round takes the links that a bypass would have given it.
        links = cut_lineage(_without(links, gone).union(_without(short, gone)).distinct())


def _spread(start: DataFrame, links: DataFrame) -> DataFrame:
    """node, colour: the largest colour that comes to each node over links(a, b), from start(node, colour) on."""
    state = start
    while True:
        came = state.select(F.col("node").alias("a"), "colour").join(links, "a").select(F.col("b").alias("node"), "colour")
        best = came.groupBy("node").agg(F.max("colour").alias("came"))
        new = cut_lineage(state.join(best, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("grew")))
        if new.where("grew").isEmpty():
            return new.select("node", "colour")
        state = new.select("node", "colour")


def _coloured(links: DataFrame) -> DataFrame:
    """node, component of the nodes of links in which every node has links both ways; a component of one node is left out."""
    found = None
    while not links.isEmpty():
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("colour")), links)
        # Backward from each colour's own node, within the colour.
        of = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca"))
        inside = cut_lineage(links.join(of, "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")))
        seen = frontier = cut_lineage(colours.where("node = colour"))
        while not frontier.isEmpty():
            came = frontier.select(F.col("node").alias("b")).join(inside, "b").select(F.col("a").alias("node"), "colour").distinct()
            frontier = cut_lineage(came.join(seen, "node", "left_anti"))
            seen = cut_lineage(seen.union(frontier))
        several = seen.join(seen.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "colour").select("node", F.col("colour").alias("component"))
        found = several if found is None else found.union(several)
        links = cut_lineage(_without(links, seen))
    return found


def strong_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of links(a, b) that lie on a cycle; a self-link is one."""
    links = cut_lineage(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    left, rounds = _contracted(links.where("a <> b"))
    found = _coloured(left)
    found = alone.limit(0) if found is None else found
    for passed in reversed(rounds):
        # A neighbour that no component was found for stands for itself.
        before = found.select(F.col("node").alias("before"), F.col("component").alias("cb"))
        after = found.select(F.col("node").alias("after"), F.col("component").alias("ca"))
        placed = passed.join(before, "before", "left").join(after, "after", "left").withColumns({"cb": F.coalesce("cb", "before"), "ca": F.coalesce("ca", "after")}).where("cb = ca")
        new = placed.select("node", F.col("cb").alias("component"))
        # Where a ring closed on one node, that node joins its component.
        closing = placed.where("before = after").select(F.col("before").alias("node"), F.col("cb").alias("component"))
        found = cut_lineage(found.union(new).union(closing).distinct())
    found = found.union(alone.join(found, "node", "left_anti"))
    smallest = found.groupBy("component").agg(F.min("node").alias("least"))
    return cut_lineage(found.join(smallest, "component").select("node", F.col("least").alias("component")))


def links_within(links: DataFrame, components: DataFrame) -> DataFrame:
    """component, a, b: the links of links(a, b) that lie within a component."""
    ends = [components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab"]
    return links.join(ends[0], "a").join(ends[1], "b").where("of_a = of_b").select(F.col("of_a").alias("component"), "a", "b")


def ring_orders(rings: DataFrame) -> DataFrame:
    """component, cycle: the nodes of each ring (component, a, b; one link from each node) from its smallest on, that one again
    at the end. Ranks come by pointer doubling: after k rounds each node knows what lies 2^k links on."""
    # The way ends at the smallest node: left counts the links to it.
    state = cut_lineage(rings.select("component", F.col("a").alias("node"), F.when(F.col("b") != F.col("component"), F.col("b")).alias("to"), F.lit(1).cast("long").alias("left")))
    while not state.where("to IS NOT NULL").isEmpty():
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("left").alias("more"))
        state = cut_lineage(state.join(ahead, "to", "left").select("component", "node", F.col("then").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    ordered = state.groupBy("component").agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), "node"))).alias("nodes"))
    return ordered.select("component", F.concat(F.transform("nodes", lambda x: x["node"]), F.array("component")).alias("cycle"))
