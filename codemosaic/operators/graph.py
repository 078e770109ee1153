"""The symbol graph of a corpus as tables: edges, references, impact, cycles, orphans, health.

Ties that names shared by several symbols leave open are settled the same way everywhere: the smallest (file, pattern_ord,
byte_start, symbol_id) has a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.strings import lines as text_lines
from ..plans.session import cut_lineage
from .components import links_within, ring_orders, strong_components
from .symbols import extract_symbols, imports, is_exported, nodes_of, resolved

#: Links beyond those of a ring that a component may have and still give all its elementary cycles (2 to this power at most, and one).
CHOICES = 12

#: Bytes of names that one automaton is made of; more names are looked for in several passes over the signatures.
NAME_BYTES = 8 << 20

#: Bytes of rows that a join sends to all workers; more are joined by a shuffle. Bytes that a row of two numbers has there.
SENT_BYTES, SENT_ROW = 64 << 20, 48

_TOKEN = re.compile(r"\w+")


def names(nodes: DataFrame) -> DataFrame:
    """name, to_id: the symbol that has a name."""
    order = F.struct("file", "pattern_ord", "byte_start", "symbol_id")
    return nodes.groupBy("name").agg(F.min_by("symbol_id", order).alias("to_id"))


def _automaton(wanted: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in wanted:
        found.add_word(name, name)
    if wanted:
        found.make_automaton()
    return found


def _shards(wanted: DataFrame, most: int) -> Iterator[list[str]]:
    """The names of wanted(name), in lists of at most about so many bytes (of one name, if that has more)."""
    size = wanted.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    n = -(-size // most)
    for i in range(n):
        yield sorted(r.name for r in wanted.where(F.pmod(F.xxhash64("name"), F.lit(n)) == i).collect())


def names_within(nodes: DataFrame, wanted: DataFrame, most: int = NAME_BYTES) -> DataFrame:
    """from_id, name: which of the distinct, non-empty names of wanted(name) stand anywhere in each node's signature.

    An automaton of many patterns (Aho-Corasick) walks each signature once and gives what matches, so there are as many rows as
    matches. A list of names of bounded bytes is sent to the workers; more names are several lists, each a pass.
    """
    context = nodes.sparkSession.sparkContext
    asked = nodes.select(F.col("symbol_id").alias("from_id"), "signature")
    out = None
    for shard in _shards(wanted.where("name <> ''"), most):
        sent = context.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            for b in batches:
                ids, hits = [], []
                for from_id, signature in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = {name for _, name in automaton.iter(signature)} if signature else ()
                    ids += [from_id] * len(own)
                    hits += sorted(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hits, pa.string())], ["from_id", "name"])

        found = asked.mapInArrow(run, "from_id string, name string")
        out = found if out is None else out.union(found)
    return nodes.sparkSession.createDataFrame([], "from_id string, name string") if out is None else out


def edges_between(within: DataFrame, owners: DataFrame) -> DataFrame:
    """from_id, to_id, edge_type of names within signatures and the symbols (names()) that have them."""
    found = within.join(owners, "name").where("from_id <> to_id")
    return found.select("from_id", "to_id", F.lit("Uses").alias("edge_type"))


def edges(nodes: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """from_id, to_id, edge_type: a symbol uses every other whose name stands anywhere in its signature."""
    owners = names(nodes)
    return edges_between(names_within(nodes, owners.select("name"), name_bytes), owners)


LINES = "file string, line long, byte_offset long, context string, tokens array<string>"


def code_lines(files: DataFrame) -> DataFrame:
    """LINES of all files but comment lines: tokens are the distinct words of a line, and ``$`` if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "content"):
            rows = []
            for path, content in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = 0
                for i, line in enumerate(text_lines(content or "")):
                    context = line.strip()
                    if not context.startswith(("//", "#", "*")):
                        rows.append((path, i + 1, at, context, list(dict.fromkeys(_TOKEN.findall(line) + ["$"] * ("$" in line)))))
                    at += len(line.encode()) + 1
            for i in range(0, len(rows), 8192):
                columns = zip(*rows[i : i + 8192], strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in LINES.split(", ")])

    return files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("file"), "content").mapInArrow(run, LINES)


def references(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """symbol, file, line (from 1), byte_offset (of the line), context_snippet of every line that has a symbol's name as a word."""
    return references_in(words_of(files), nodes.select("name").distinct())


def words_of(files: DataFrame) -> DataFrame:
    """file, line, byte_offset, context, key: each distinct word of each line of code."""
    return code_lines(files).select("file", "line", "byte_offset", "context", F.explode("tokens").alias("key"))


def references_in(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines of words (words_of) that have one of the distinct names of wanted(name) as a word.

    A hash join of words with names. A name with ``$`` is no single word: it is joined by its first word (or ``$``, if it has
    none) and then looked for in the line.
    """
    word = F.regexp_extract("name", r"[A-Za-z0-9_]+", 0)
    wanted = wanted.withColumns({"plain": ~F.contains("name", F.lit("$")), "key": F.when(word == "", "$").otherwise(word)})
    found = words.join(wanted, "key")
    pattern = F.concat(F.lit(r"(?<![\p{IsAlphabetic}\p{N}_])\Q"), F.col("name"), F.lit(r"\E(?![\p{IsAlphabetic}\p{N}_])"))
    found = found.where(F.col("plain") | F.when(~F.col("plain"), F.rlike("context", pattern)))
    return found.select(F.col("name").alias("symbol"), "file", "line", "byte_offset", F.col("context").alias("context_snippet"))


def risk(n_references: Column, n_files: Column) -> Column:
    # Limits of each grade (fixed values).
    return (
        F.when((n_references > 15) | (n_files > 5), "CRITICAL").when((n_references >= 6) | (n_files >= 3), "HIGH")
        .when((n_references >= 2) | (n_files >= 1), "MEDIUM").otherwise("LOW")
    )


def reach(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """start, node, depth (1 or more) of all that starts(start, node) reach over links(here, there) in at most depth steps.

    One join a level; nodes seen before are left out by an anti-join, so each is reached once, at its smallest depth.
    """
    seen = cut_lineage(starts.select("start", "node", F.lit(0).alias("depth")))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["here"]).select("start", F.col("there").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(level).alias("depth")))
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def _sent_if_few(rows: DataFrame) -> DataFrame:
    """Rows of at most two numbers, from files, to be broadcast in joins unless they are many."""
    return F.broadcast(rows) if rows.count() * SENT_ROW <= SENT_BYTES else rows


def centres(links: DataFrame) -> DataFrame:
    """here, there: links(here, there), distinct and both ways, to those nodes alone whose neighbourhoods (a node and what it is linked
    to) lie in no other's. Of equal neighbourhoods one counts. Each node is linked to such a node or is one itself (it is then
    linked to itself), and its neighbours' neighbourhoods together are those of the nodes it is linked to here: where one
    neighbourhood holds another, it holds the other's nodes' way to it too.

    A node's neighbourhood lies in a neighbour's if all its other links close to triangles with that neighbour. Triangles are
    looked for from their node of fewest links, so a node of many links makes no pairs: what the two ends of a link have above them
    are two lists (of at most the square root of twice the links each), which move once a link and are intersected.
    """
    degrees = cut_lineage(links.groupBy("here").agg(F.count(F.lit(1)).alias("n")))
    sent = _sent_if_few(degrees)
    ranked = links.join(sent, "here").join(sent.select(F.col("here").alias("there"), F.col("n").alias("m")), "there")
    up = cut_lineage(ranked.where(F.struct("n", "here") < F.struct("m", "there")).select("here", "there", "n"))
    above = up.groupBy("here").agg(F.collect_list("there").alias("above"))
    of_one, of_two = above.withColumnRenamed("above", "one"), above.select(F.col("here").alias("there"), F.col("above").alias("two"))
    closed = up.select("here", "there").join(of_one, "here").join(of_two, "there").select("here", "there", F.array_intersect("one", "two").alias("third")).where(F.size("third") > 0)
    side = lambda a, b, n: F.struct(a.alias("here"), b.alias("there"), n.alias("met"))
    here, there, once = F.col("here"), F.col("there"), F.lit(1)
    sides = F.concat(F.array(side(here, there, F.size("third"))), F.transform("third", lambda x: side(here, x, once)), F.transform("third", lambda x: side(there, x, once)))
    met = closed.select(F.explode(sides).alias("s")).groupBy("s.here", "s.there").agg(F.sum("s.met").alias("met"))
    within = up.join(met, ["here", "there"], "left").where(F.coalesce("met", F.lit(0)) == F.col("n") - 1).select("here").distinct()
    kept = cut_lineage(degrees.join(within, "here", "left_anti").select("here"))
    to_kept = links.join(_sent_if_few(kept).select(F.col("here").alias("there")), "there", "left_semi")
    return to_kept.select("here", "there").union(kept.select("here", F.col("here").alias("there")))


def numbered(symbol_id: Column) -> Column:
    """A symbol's id, 16 hexadecimal digits, as the long of the same bits: less to move, and each id has its own."""
    return F.conv(symbol_id, 16, -10).cast("long")


def alike(starts: DataFrame, links: DataFrame, depth: int, shared: bool = True) -> tuple[DataFrame, DataFrame]:
    """((start, node, ball), (ball, node)): starts(start, node) with the name of what each reaches in at most depth steps over
    links(here, there), distinct and both ways (nodes are numbered()), and the nodes of each such ball, each once and starts included.

    From two steps on, starts that are linked to the same centres() reach the same, so they share a ball that is made once: rows
    grow with balls that differ, not with starts times what they reach. Not shared (for few starts): a ball for each start.
    """
    if depth < 2 or not shared:
        own = starts.select(F.col("node").alias("start"), "node").distinct()
        return starts.withColumn("ball", F.col("node")), own.union(reach(own, links, depth).select("start", "node")).withColumnRenamed("start", "ball")
    to = centres(links)
    near = starts.select("node").distinct().join(to, F.col("node") == F.col("here"), "left").select("node", F.coalesce("there", "node").alias("centre"))
    near = cut_lineage(near)
    # Nodes are numbers: none holds a comma.
    told = cut_lineage(near.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("centre")).cast("array<string>"), ",").cast("binary"), 256).alias("told")))
    least = cut_lineage(told.groupBy("told").agg(F.min("node").alias("ball")))
    held = near.join(least, F.col("node") == F.col("ball")).select(F.col("ball").alias("start"), F.col("centre").alias("node"))
    if depth > 2:
        between = to.join(to.where("here = there").select("here"), "here", "left_semi").where("here <> there")
        held = held.union(reach(held, between, depth - 2).select("start", "node"))
    held = cut_lineage(held)
    step = links.join(_sent_if_few(held), F.col("node") == F.col("here")).select("start", F.col("there").alias("node"))
    return starts.join(told, "node").join(least, "told").select("start", "node", "ball"), held.union(step).distinct().withColumnRenamed("start", "ball")


def _told(text: Column) -> Column:
    """What stands for a path in a join: two hashes and its length."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("m"), F.length(text).alias("n"))


def _endings(c: str) -> Column:
    """A row for each ending of a path, of fixed size."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: _told(F.col(c).substr(i, F.length(c))))).alias("told")


class CodeCorpus:
    """Files and the tables made from them; each is made on first use and kept for the next."""

    def __init__(self, files: DataFrame):
        last = F.max_by(F.struct("language", "content"), F.struct("language", "content")).alias("f")  # one row a path
        self.files = files.groupBy(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).agg(last).select("path", "f.language", "f.content")
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def from_dataframe(cls, files: DataFrame) -> CodeCorpus:
        """files(path, language, content); of several rows of a path one stands."""
        return cls(files)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def _kept(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._made[name]

    def unpersist(self) -> None:
        for df in self._made.values():
            df.unpersist()
        self._made.clear()

    @property
    def symbols(self) -> DataFrame:
        return self._kept("symbols", lambda: extract_symbols(self.files, with_docs=True))

    @property
    def nodes(self) -> DataFrame:
        return self._kept("nodes", lambda: nodes_of(self.symbols))

    @property
    def edges(self) -> DataFrame:
        return self._kept("edges", lambda: edges(self.nodes))

    @property
    def references(self) -> DataFrame:
        return self._kept("references", lambda: references(self.files, self.nodes))

    @property
    def imports(self) -> DataFrame:
        return self._kept("imports", lambda: imports(self.files))

    def upsert(self, files: DataFrame) -> CodeCorpus:
        """A corpus with these files put in or replaced."""
        new = files.select("path", "language", "content")
        return CodeCorpus(self.files.join(new.select("path").distinct(), "path", "left_anti").unionByName(new))

    def find_references(self, symbol: str) -> DataFrame:
        return self.references.where(F.col("symbol") == symbol).orderBy("file", "line")

    def resolve_symbol(self, symbol: str, from_file: str | None = None) -> DataFrame:
        """The symbol of a name, from_file's own before others; no row if there is none."""
        own = F.col("file") == F.lit((from_file or "").replace("\\", "/"))
        node = self.nodes.where(F.col("name") == symbol).orderBy(F.when(own, 0).otherwise(1), F.when(own, "").otherwise(F.col("file")), "pattern_ord", "byte_start", "symbol_id").limit(1)
        return resolved(node)

    def resolve_symbols(self, wanted: DataFrame) -> DataFrame:
        """For each of wanted(name, from_file), from_file null or not: the nodes' columns of the symbol that is meant, null if there is
        none. Nodes are reduced before they are joined, to the first of each name in each file and the first of each name: so a
        name that every file declares, asked for from every file, makes a row a question and not one for each pair."""
        asked = wanted.select(F.col("name").alias("wanted"), F.replace("from_file", F.lit("\\"), F.lit("/")).alias("from_file")).distinct()
        nodes = self.nodes.select(F.col("name").alias("has"), F.col("file").alias("at"), F.struct(*self.nodes.columns).alias("node"))
        order = F.struct("node.file", "node.pattern_ord", "node.byte_start", "node.symbol_id")
        own = nodes.groupBy("has", "at").agg(F.min_by("node", order).alias("own"))
        first = nodes.groupBy("has").agg(F.min_by("node", order).alias("first")).withColumnRenamed("has", "named")
        here = (F.col("wanted") == F.col("has")) & F.col("from_file").eqNullSafe(F.col("at"))
        found = asked.join(own, here, "left").join(first, F.col("wanted") == F.col("named"), "left")
        return found.select("wanted", "from_file", F.coalesce("own", "first").alias("node")).select("wanted", "from_file", "node.*")

    def impact_all(self, depth: int = 2, starts: DataFrame | None = None) -> DataFrame:
        """A report for each of starts(symbol, file, symbol_id): dependents in up to depth steps and references from other
        files. Without starts: for each name, from the symbol that has it."""
        nodes = self.nodes
        if starts is None:
            starts = names(nodes).select(F.col("name").alias("symbol"), F.col("to_id").alias("symbol_id")).join(nodes.select("symbol_id", "file"), "symbol_id")
        who = nodes.select(F.col("symbol_id").alias("node"), F.concat("name", F.lit(" ("), "file", F.lit(")")).alias("caller"), F.col("file").alias("at"))
        links = self.edges.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"))
        found = reach(starts.where("symbol_id IS NOT NULL").select(F.col("symbol").alias("start"), F.col("symbol_id").alias("node")), links, depth).join(who, "node")
        by_edge = found.select(F.col("start").alias("symbol"), F.struct("depth", "caller").alias("dep"), F.col("at"))
        refs = self.references.join(starts.select("symbol", F.col("file").alias("origin")), "symbol")
        other = refs.where("file <> origin").select("symbol", F.struct(F.lit(1).alias("depth"), F.concat("file", F.lit(":L"), "line").alias("caller")).alias("dep"), F.col("file").alias("at"))
        said = by_edge.union(other).groupBy("symbol").agg(F.collect_set("dep").alias("deps"), F.collect_set("at").alias("files"))
        counted = self.references.groupBy("symbol").agg(F.count(F.lit(1)).alias("reference_count"))
        out = starts.select("symbol", F.col("file").alias("origin_file")).join(said, "symbol", "left").join(counted, "symbol", "left")
        out = out.withColumns({"affected_files": F.sort_array(F.coalesce("files", F.array().cast("array<string>"))), "reference_count": F.coalesce("reference_count", F.lit(0))})
        deps = F.coalesce("deps", F.array().cast("array<struct<depth:int,caller:string>>"))
        listed = lambda cond: F.sort_array(F.transform(F.filter(deps, cond), lambda d: d["caller"]))
        return out.select(
            "symbol", "origin_file", listed(lambda d: d["depth"] == 1).alias("direct_dependents"), listed(lambda d: d["depth"] > 1).alias("transitive_dependents"),
            "affected_files", risk(F.col("reference_count"), F.size("affected_files")).alias("risk_score"), "reference_count",
        )

    def impact(self, symbol: str, file: str | None = None, depth: int = 2) -> DataFrame:
        """The report of one symbol, one row; a name that nothing has still gets its references."""
        node = self.resolve_symbol(symbol, file).select("file", "symbol_id", "name")
        one = self.spark.createDataFrame([(symbol, file or "unknown")], "symbol string, given string")
        starts = one.join(node, one["symbol"] == node["name"], "left").select("symbol", F.coalesce("file", "given").alias("file"), "symbol_id")
        return self.impact_all(depth, starts)

    # --- imports ---

    def import_links(self) -> DataFrame:
        """file, ord, target_file: imports of files of the corpus, by exact path or else by suffix either way (smallest path).

        Two equi-joins on endings, by their hashes: targets with the endings of paths, of which only the smallest path each is
        kept before anything moves, and paths with the endings of distinct targets. So rows grow with the paths' characters, and
        neither a common file name nor a target that many files import makes a large group.
        """
        keys = self.files.select(F.col("path").alias("target_file")).where("target_file <> ''")
        imported = self.imports.where("target <> ''")
        exact = imported.join(keys, imported["target"] == keys["target_file"]).select("file", "ord", "target", "target_file")
        rest = imported.join(keys, imported["target"] == keys["target_file"], "left_anti")
        asked = rest.select("target").distinct()
        ends = keys.select("target_file", _endings("target_file")).groupBy("told").agg(F.min("target_file").alias("target_file"))
        longer = asked.select("target", _told(F.col("target")).alias("told")).join(ends, "told").select("target", "target_file")
        shorter = asked.select("target", _endings("target")).join(keys.select("target_file", _told(F.col("target_file")).alias("told")), "told").select("target", "target_file")
        least = longer.union(shorter).groupBy("target").agg(F.min("target_file").alias("target_file"))
        return exact.union(rest.join(least, "target").select("file", "ord", "target", "target_file"))

    def import_components(self) -> DataFrame:
        """node, component: the files that lie on a cycle of imports, and the smallest file of those they share cycles with."""
        return self._kept("components", lambda: strong_components(self._links()))

    def _links(self) -> DataFrame:
        return self._kept("links", lambda: self.import_links().select(F.col("file").alias("a"), F.col("target_file").alias("b")).distinct())

    def cyclic_components(self) -> DataFrame:
        """component, n_files, n_links, kind: ring (each file imports one other), self, or mesh (several cycles share files)."""
        inside = links_within(self._links(), self.import_components())
        sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("a").alias("n_files"))
        kind = F.when(F.col("n_links") > F.col("n_files"), "mesh").when(F.col("n_files") == 1, "self").otherwise("ring")
        return sizes.select("component", "n_files", "n_links", kind.alias("kind"))

    def import_cycles(self, most: int | None = None, choices: int = CHOICES) -> DataFrame:
        """cycle: array of files, the first again at the end, from its smallest file on.

        Rings come whole, by pointer doubling. In a mesh each elementary cycle comes once, grown from each start over larger
        files of its component; their number can double with each link beyond a ring, so a mesh of more than ``choices``
        such links gives instead, for each of its links, the shortest cycle through it (of equally short ones the least), once.
        most: the most links of a cycle that is looked for (with it, every mesh gives all its elementary cycles up to there).
        """
        sizes = self.cyclic_components()
        inside = cut_lineage(links_within(self._links(), self.import_components()).join(sizes, "component"))
        links = inside.select("component", "a", "b", "kind", (F.col("n_links") - F.col("n_files") > choices).alias("dense"))
        closed = links.where("a = b").select(F.array("a", "b").alias("cycle"))
        rings = links.where("kind = 'ring'").select("component", "a", "b")
        if most is None:
            closed = closed.union(ring_orders(rings).select("cycle"))
        meshes = links.where("a <> b" if most is not None else "a <> b AND kind = 'mesh' AND NOT dense").select("component", "a", "b")
        closed = closed.union(self._grown(meshes, most))
        dense = links.where("a <> b AND kind = 'mesh' AND dense").select("component", "a", "b")
        return closed if most is not None else closed.union(self._shortest(dense))

    def _grown(self, links: DataFrame, most: int | None) -> DataFrame:
        """All elementary cycles within links(component, a, b)."""
        paths = links.where("a < b").select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a", "b").alias("path"))
        closed, size = links.limit(0).select(F.array("a").alias("cycle")), 2
        while most is None or size <= most:
            paths = cut_lineage(paths)
            if paths.isEmpty():
                break
            grown = paths.join(links, F.col("at") == F.col("a"))
            closed = closed.union(grown.where("b = start").select(F.concat("path", F.array("b")).alias("cycle")))
            paths = grown.where((F.col("b") > F.col("start")) & ~F.array_contains("path", F.col("b"))).select("start", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
            size += 1
        return closed

    def _shortest(self, links: DataFrame) -> DataFrame:
        """For each of links(component, a, b) the shortest cycle through it: from its end, all files one step on, until its begin is met.
        Each file is entered once for a link, on the least of the shortest ways, so rows are bounded by links times files."""
        frontier = seen = cut_lineage(links.select(F.col("a").alias("start"), F.col("b").alias("via"), F.col("b").alias("at"), F.array("a", "b").alias("path")))
        closed = links.limit(0).select(F.array("a").alias("cycle"))
        while not frontier.isEmpty():
            step = frontier.join(links, F.col("at") == F.col("a")).select("start", "via", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
            step = step.groupBy("start", "via", "at").agg(F.min("path").alias("path"))
            met = cut_lineage(step.join(seen.select("start", "via", "at"), ["start", "via", "at"], "left_anti"))
            done = met.where("at = start")
            closed = closed.union(done.select(F.col("path").alias("cycle")))
            frontier = cut_lineage(met.join(done.select("start", "via"), ["start", "via"], "left_anti"))
            seen = cut_lineage(seen.select("start", "via", "at").union(frontier.select("start", "via", "at")))
        # From the smallest file on, each once.
        ring = F.slice("cycle", 1, F.size("cycle") - 1)
        at = F.array_position(ring, F.array_min(ring)).cast("int")
        turned = F.concat(F.slice(ring, at, F.size(ring) - at + 1), F.slice(ring, F.lit(1), at - 1))
        return closed.select(F.concat(turned, F.array(F.array_min(ring))).alias("cycle")).distinct()


    def orphan_exports(self) -> DataFrame:
        """orphan: exported symbols that no other file names."""
        exported = self.nodes.where(is_exported(F.col("signature")) & ~F.col("name").isin("main", "default"))
        # Another file names a symbol unless all files that do are its own: the least and the greatest of them tell.
        used = self.references.groupBy(F.col("symbol").alias("name")).agg(F.min("file").alias("least"), F.max("file").alias("greatest"))
        left = exported.join(used, "name", "left").where(F.col("least").isNull() | ((F.col("least") == F.col("file")) & (F.col("greatest") == F.col("file"))))
        return left.select(F.concat("name", F.lit(" ("), "file", F.lit(":"), "signature", F.lit(")")).alias("orphan"))

    def health(self) -> DataFrame:
        """One row: counts, cycles and orphans."""
        cycles = self.import_cycles().agg(F.sort_array(F.collect_list("cycle")).alias("circular_dependencies"))
        orphans = self.orphan_exports().agg(F.sort_array(F.collect_list("orphan")).alias("orphan_exports"))
        return self.spark.sql(
            "SELECT (SELECT * FROM {cycles}) AS circular_dependencies, (SELECT * FROM {orphans}) AS orphan_exports,"
            " (SELECT count(*) FROM {files}) AS total_files, (SELECT count(*) FROM {nodes}) AS total_symbols, (SELECT count(*) FROM {edges}) AS total_edges",
            files=self.files, nodes=self.nodes, edges=self.edges, cycles=cycles, orphans=orphans,
        )
