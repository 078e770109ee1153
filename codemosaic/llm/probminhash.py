"""Near-duplicate detection by ProbMinHash.

A document is the bag of its shingles of WORDS words (lower case, split at white space), weighted by their counts. For every
shingle a Poisson process with its weight as rate throws arrivals into M registers; a register keeps the shingle
that arrived first, and a process ends as soon as its time is beyond the document's slowest register. Two documents
agree in a register with the probability Jaccard similarity of their weights (plain Jaccard where all weights are equal).

Two documents are linked if their plain or their probability Jaccard similarity is at least SIMILARITY. A text that says a
shingle more than once so has two sets of registers, one by its counts and one by weights of 1; both give it bands.

Candidates come from BANDS bands of ROWS registers:
- equal texts are one node from the start, however many copies there are;
- a bucket of at most SMALL nodes gives its pairs;
- in a larger bucket every node is paired with up to LEADERS leaders, drawn among the nodes that lie in most large buckets (the
  nearest to what the bucket has in common). Its nodes are also dealt out anew by pairs of large buckets that they share; of
  those finer buckets the ones of at most FINE nodes give their pairs, the others pair every node with a leader drawn by hash,
  another in each. So these pairs grow in proportion to the nodes.
Pairs whose registers agree in less than LEAST_AGREED go (five standard deviations below the limit: about one link in ten
million); the rest are verified on their whole shingle sets. Components of these links are the first pass.

The second pass makes up for the pairs that larger buckets left out: of every larger bucket whose nodes are in several components, all
pairs across components are compared on their whole shingle sets, in blocks of bounded size. The nodes of the bucket's largest
component meet only the others, so a group that the first pass has joined costs its few stragglers times its size; a group of
unlinked nodes (a long passage that many share) costs its square. Classes are the components of both passes' links, so of
nodes that share a band none that are linked stay apart, whatever SMALL, LEADERS and FINE are.

The documents are read up to four times (features, bags of both passes, the rows that stay), so they should be a table or what costs no
more than one to make.

Defined cases: null text counts as empty; all empty texts are equal, so one class; a text of fewer than WORDS words is
one shingle; repeated rows are copies, of which one stands for the class; the class id is the smallest doc_id of the class
(null only if all are null); an empty table gives an empty table; a very long text is a step of its own; other columns are kept by the stage and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, keep_nothing, kept_in_worker, materialize, steps, texts_of
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
M = BANDS * ROWS
SMALL, LEADERS, FINE, NEAR_BANDS = 12, 3, 4, 2
#: Five standard deviations of the estimate from M registers below SIMILARITY.
LEAST_AGREED = 0.617
#: A block of the second pass has about so many nodes, or bytes of their shingle sets, at most.
BLOCK_NODES, BLOCK_BYTES = 256, 1 << 20

#: bands: BANDS by counts, then (null where equal) BANDS by weights of 1; registers: M of two bytes by counts, then by weights of 1.
FEATURES = "doc_id long, node binary, bands array<long>, registers binary, size long"
#: Shingle hashes ascending, eight bytes each, and their counts, four bytes each (none if all are 1).
BAGS = "node binary, shingles binary, counts binary"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; keeps the hashes of words seen before, up to a bound."""

    def __init__(self, most: int = 100_000):
        self.words: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles (ascending) and their counts."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = self.words
        if len(known) > self.most:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(h))):
            out = _mixed(out + h[k : k + n] * _PLACE[k])
        return np.unique(out, return_counts=True)


def registers(shingles: list[np.ndarray], weights: list[np.ndarray], m: int = M) -> np.ndarray:
    """The m registers (shingle hashes) of each document; a row of zeros for a document without shingles."""
    docs = len(shingles)
    time = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    if not docs:
        return kept.reshape(0, m)
    doc = np.repeat(np.arange(docs), [len(x) for x in shingles])
    element = np.concatenate(shingles)
    rate = np.concatenate(weights).astype(float)
    now = np.zeros(len(element))
    state = _mixed(element + _MIX[2])
    slowest = np.full(docs, np.inf)
    while len(element):  # the next arrival of every process that may still come in time
        state = state + _MIX[2]
        draw = _mixed(state)
        now = now - np.log1p(-((draw >> np.uint64(11)).astype(float) * 2.0**-53)) / rate
        register = doc * m + (_mixed(draw ^ _MIX[1]) % np.uint64(m)).astype(np.int64)
        first = np.flatnonzero(now < time[register])
        order = first[np.lexsort((element[first], now[first]))[::-1]]  # the earliest is written last
        time[register[order]] = now[order]
        kept[register[order]] = element[order]
        slowest = time.reshape(docs, m).max(axis=1)
        on = now < slowest[doc]
        doc, element, rate, now, state = doc[on], element[on], rate[on], now[on], state[on]
    return kept.reshape(docs, m)


def bands_of(kept: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each document's registers."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _MIX[2] + np.zeros((len(kept), 1), np.uint64)
    for r in range(ROWS):
        out = _mixed(out + parts[:, :, r])
    return out.view(np.int64)


def sketches(sets: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[list[int | None]], list[bytes]]:
    """The bands and registers of FEATURES."""
    twice = [i for i, c in enumerate(counts) if c.max(initial=1) > 1]
    kept = registers([*sets, *(sets[i] for i in twice)], [*counts, *(np.ones(len(sets[i])) for i in twice)])
    bands, short = bands_of(kept), (kept >> np.uint64(48)).astype(np.uint16)
    keys = [x if len(s) else [] for x, s in zip(bands[: len(sets)].tolist(), sets, strict=True)]
    packed = [x.tobytes() for x in short[: len(sets)]]
    for k, i in enumerate(twice, len(sets)):
        keys[i] = keys[i] + [None if x == y else y for x, y in zip(keys[i], bands[k].tolist(), strict=True)]
        packed[i] += short[k].tobytes()
    return keys, packed


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of docs(doc_id, text): node names the text, the rest is what candidates and verification need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept_in_worker("shingler", Shingler)
        for b in steps(batches, "text", most=1 << 20):
            texts = texts_of(b.column("text"))
            sets, counts = zip(*map(shingle, texts), strict=True)
            bands, packed = sketches(list(sets), list(counts))
            columns = [
                b.column("doc_id"),
                pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(packed, pa.binary()),
                pa.array([8 * len(x) for x in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FEATURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def _node(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("node")


def packed_bag(text: str, shingle: Shingler) -> tuple[bytes, bytes]:
    """The shingles and counts of BAGS."""
    ids, counts = shingle(text)
    return ids.tobytes(), b"" if counts.max(initial=1) == 1 else counts.astype(np.uint32).tobytes()


def wanted_bags(docs: DataFrame, copies: DataFrame, wanted: DataFrame) -> DataFrame:
    """BAGS of each wanted node, one row each, written, made anew from the text of the node's first document: most documents are
    like no other, so their shingles are never stored. Only wanted rows leave their place, and joins with the outcome are of
    plain shuffles, whose hot keys adaptive execution splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept_in_worker("shingler", Shingler)
        for b in steps(batches, "text", most=1 << 20):
            found = [packed_bag(t, shingle) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array(x, pa.binary()) for x in zip(*found, strict=True))], [c.split()[0] for c in BAGS.split(", ")])

    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))).alias("own")
    first = copies.join(broadcast_if_few(wanted.select("node").distinct(), "wanted"), "node", "left_semi").select("node", own("low.doc_id"))
    named = docs.select(_node("text"), own("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = named.join(broadcast_if_few(first, "first"), ["node", "own"], "left_semi").select("node", "text").mapInArrow(run, BAGS)
    return materialize(made.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts")), "bags")


def similarity(a: bytes, a_counts: bytes, b: bytes, b_counts: bytes) -> float:
    """The larger of plain and probability Jaccard similarity of two shingle bags."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    union = len(x) + len(y) - len(i)
    if not union:
        return 1.0
    plain = len(i) / union
    if plain >= SIMILARITY or not (a_counts or b_counts) or not len(i):
        return plain
    wx = np.frombuffer(a_counts, np.uint32).astype(float) if a_counts else np.ones(len(x))
    wy = np.frombuffer(b_counts, np.uint32).astype(float) if b_counts else np.ones(len(y))
    both_x, both_y = wx[i], wy[j]
    order = np.argsort(both_x / both_y, kind="stable")
    both_x, both_y = both_x[order], both_y[order]
    only_x, only_y = wx.sum() - both_x.sum(), wy.sum() - both_y.sum()
    # sum over u of max(x_u / x_d, y_u / y_d): x's weight counts where the ratio of u is not below that of d
    above = only_x + np.cumsum(both_x[::-1])[::-1]
    below = only_y + np.cumsum(both_y) - both_y
    return max(plain, float((1 / (above / both_x + below / both_y)).sum()))


def _pairs(buckets: DataFrame, most: int, rank: Column, leaders: int) -> DataFrame:
    """(a, b), a < b, from buckets(key, n, node, ...): all pairs of those of at most so many nodes, pairs with the
    leaders of the others, each the node of the largest (rank, hash). Leaders are maxima, so a bucket's rows are reduced
    before they are dealt out."""
    small = buckets.where(F.col("n") <= most).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    small = small.select(F.posexplode("nodes").alias("i", "a"), "nodes").select("a", F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("b"))
    large = buckets.where(F.col("n") > most)
    led = large.groupBy("key").agg(*[F.max(F.struct(rank.alias("rank"), F.xxhash64("node", "key", F.lit(k)).alias("h"), "node")).alias(f"l{k}") for k in range(leaders)])
    led = led.select("key", F.explode(F.array_distinct(F.array(*[f"l{k}.node" for k in range(leaders)]))).alias("leader"))
    large = large.join(broadcast_if_few(led, "leaders"), "key").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return small.union(large)


def _sized(keyed: DataFrame) -> DataFrame:
    """keyed(key, node, ...) of the keys that two nodes or more have, with their number n. Few keys are shared, so most rows go
    before they are dealt out."""
    return keyed.join(broadcast_if_few(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys"), "key")


def buckets_of(nodes: DataFrame) -> DataFrame:
    """(key, node, size, band, n): the bands of nodes(node, bands, size) that two nodes or more have."""
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key")).where("key IS NOT NULL")
    return materialize(_sized(keyed.withColumn("band", F.col("band") % BANDS)), "buckets")


def candidates(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a band, by the rules of the first pass."""
    hot = buckets.where(F.col("n") > SMALL)
    own = hot.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "key"))).alias("hot"))
    ranked = buckets.join(own.select("node", F.size("hot").alias("in_hot")), "node", "left")
    first = _pairs(ranked, SMALL, F.coalesce("in_hot", F.lit(0)), LEADERS)
    near = F.expr(f"flatten(transform(hot, (x, i) -> transform(filter(slice(hot, i + 2, {NEAR_BANDS}), y -> y.band - x.band <= {NEAR_BANDS}), y -> xxhash64(x.key, y.key))))")
    fine = _sized(own.select("node", F.explode(near).alias("key")))
    second = _pairs(fine, FINE, F.lit(0), 1)
    return first.union(second).distinct()


def links(nodes: DataFrame, pairs: DataFrame, bags_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of nodes of FEATURES rows that hold when verified on their bags."""
    pairs = materialize(pairs, "pairs")
    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select(F.col("b").alias("node")))
    side = lambda df, x: df.select(F.col("node").alias(x), *[F.col(c).alias(c[0] + x) for c in df.columns if c != "node"])

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for b in batches:
            if b.num_rows:
                rows = [b.column(c).to_pylist() for c in ("ra", "rb")]
                agreed = []
                for part in (slice(2 * M), slice(-2 * M, None)):  # by counts; by weights of 1
                    x, y = (np.frombuffer(b"".join(r[part] for r in end), np.uint16).reshape(-1, M) for end in rows)
                    agreed.append((x == y).mean(axis=1))
                keep = pa.array(np.maximum(*agreed) >= LEAST_AGREED)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("sa", "ca", "sb", "cb")), strict=True)
            keep = pa.array([similarity(*x) >= SIMILARITY for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep)

    held = nodes.join(broadcast_if_few(ends(pairs).distinct(), "paired"), "node", "left_semi")
    one = materialize(held.groupBy("node").agg(F.first("registers").alias("registers")), "registers")
    likely = materialize(pairs.join(side(one, "a"), "a").join(side(one, "b"), "b").select("a", "b", "ra", "rb").mapInArrow(rough, "a binary, b binary"), "likely")
    own = bags_of(ends(likely))
    return likely.join(side(own, "a"), "a").join(side(own, "b"), "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(exact, "a binary, b binary")


def _shared(x: list[np.ndarray], y: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each bag of x has in common with each of y, or their weight in x."""
    out = np.zeros((len(x), len(y)))
    sides = []
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    for bags, w in ((x, weights), (y, None)):
        flat, bag = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        held = np.flatnonzero(both[at] == flat) if len(both) else np.empty(0, np.int64)
        order = held[np.argsort(at[held], kind="stable")]
        sides.append((at[order], bag[order], np.concatenate(w)[order] if w else np.ones(len(order))))
    step = 1024
    for start in range(0, len(both), step):
        parts = []
        for (at, bag, w), n in zip(sides, out.shape, strict=True):
            lo, hi = np.searchsorted(at, (start, start + step))
            dense = np.zeros((n, min(step, len(both) - start)), np.float64 if weights else np.float32)
            dense[bag[lo:hi], at[lo:hi] - start] = w[lo:hi]
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def linked(x: list[tuple[bytes, bytes]], y: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which bags (shingles, counts) of x and of y are similar: what similarity says of each pair, for all pairs at once."""
    sx, sy = ([np.frombuffer(s, np.uint64) for s, _ in z] for z in (x, y))
    both = _shared(sx, sy)
    union = np.array([len(s) for s in sx])[:, None] + np.array([len(s) for s in sy])[None, :] - both
    plain = np.divide(both, union, out=np.ones_like(both), where=union > 0)
    out = plain >= SIMILARITY
    counted = np.array([bool(c) for _, c in x])[:, None] | np.array([bool(c) for _, c in y])[None, :]
    if (counted & ~out).any():
        # The probability Jaccard similarity is at most the share of either bag's weight that both have.
        wx, wy = ([np.frombuffer(c, np.uint32).astype(float) if c else np.ones(len(s) // 8) for s, c in z] for z in (x, y))
        wx, wy = [w / w.sum() for w in wx], [w / w.sum() for w in wy]
        most = np.minimum(_shared(sx, sy, wx), _shared(sy, sx, wy).T)
        for i, j in zip(*np.nonzero(counted & ~out & (most >= SIMILARITY - 1e-9)), strict=True):
            out[i, j] = similarity(*x[i], *y[j]) >= SIMILARITY
    return out


def _compare(t: pa.Table) -> pa.Table:
    """Links (a, b) of labels that two blocks, or one with itself, give; only as many as connect what they connect."""
    keep_nothing()
    names = t.column("label").to_pylist()
    left = t.column("left").to_numpy()
    bags = list(zip(t.column("shingles").to_pylist(), t.column("counts").to_pylist(), strict=True))
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    if not t.column("cross")[0].as_py() and t.column("i")[0] == t.column("j")[0]:
        y = x
    out: list[tuple[bytes, bytes]] = []
    if len(x) and len(y):
        _, label = np.unique(np.array(names, object), return_inverse=True)
        top = {}

        def find(u: int) -> int:
            while (v := top.get(u, u)) != u:
                top[u] = u = top.get(v, v)
            return u

        found = linked([bags[i] for i in x], [bags[j] for j in y]) & (label[x][:, None] != label[y][None, :])
        for i, j in zip(*np.nonzero(found), strict=True):
            a, b = find(int(label[x[i]])), find(int(label[y[j]]))
            if a != b:
                top[a] = b
                out.append((names[x[i]], names[y[j]]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def crossing(buckets: DataFrame, labels: DataFrame, bags_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The second pass: links (a, b) of labels, from all pairs of nodes of one larger bucket that have different labels."""
    named = buckets.where(F.col("n") > SMALL).select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "named")
    each = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    of = each.groupBy("key").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("top.n < n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_BYTES)).cast("int")
    of = of.select("key", F.col("top.label").alias("top"), blocks(F.col("top.n"), F.col("top.size")).alias("n_top"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("n_odd"))
    mixed = named.join(broadcast_if_few(of, "mixed"), "key").withColumn("odd", F.col("label") != F.col("top"))
    mixed = mixed.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.when(F.col("odd"), F.col("n_odd")).otherwise(F.col("n_top"))).cast("int"))
    among = "transform(sequence(0, n_odd - 1), k -> struct(false AS cross, least(own, k) AS i, greatest(own, k) AS j, own <= k AS left))"
    across = "transform(sequence(0, n_top - 1), k -> struct(true AS cross, own AS i, k AS j, true AS left))"
    back = "transform(sequence(0, n_odd - 1), k -> struct(true AS cross, k AS i, own AS j, false AS left))"
    dealt = mixed.select("key", "node", "label", F.expr(f"inline(if(odd, concat({among}, {across}), {back}))"))
    dealt = materialize(dealt, "dealt")
    return dealt.join(bags_of(dealt), "node").drop("node").groupBy("key", "cross", "i", "j").applyInArrow(_compare, "a binary, b binary")


def components_of(found: DataFrame, bags_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of the nodes of FEATURES rows that are linked to others."""
    nodes = found.where(F.size("bands") > 0)
    buckets = buckets_of(nodes.groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size")))
    labels = components(links(nodes, candidates(buckets), bags_of))
    more = materialize(crossing(buckets, labels, bags_of), "crossing")
    if more.isEmpty():
        return labels
    tops = components(more)
    moved = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return moved.union(tops.join(labels.select("node"), "node", "left_anti").select("node", "label"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, node, row) of docs(doc_id, text), row being a number of its own, and for every distinct text (node, class_id,
    class_size, low, kept_row): low is its smallest doc_id, kept_row the row of the document that stands for the class, null if
    that has another text."""
    found = materialize(features(docs).withColumn("row", F.monotonically_increasing_id()), "features")
    rows = found.select("doc_id", "node", "row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = materialize(rows.groupBy("node").agg(F.min(first).alias("low"), F.count(F.lit(1)).alias("n_copies")), "copies")
    labelled = materialize(copies.join(components_of(found, lambda wanted: wanted_bags(docs, copies, wanted)), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    of = materialize(labelled.groupBy("label").agg(F.min(F.struct("low.none", "low.doc_id", "node", "low.row")).alias("first"), F.sum("n_copies").alias("class_size")), "of_class")
    kept = F.when(F.col("node") == F.col("first.node"), F.col("first.row")).alias("kept_row")
    return rows, labelled.join(of, "label").select("node", F.col("first.doc_id").alias("class_id"), "class_size", F.col("low.doc_id").alias("low"), kept)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), class_size, is_kept (it stands for its class: one
    row of each class, also where rows repeat)."""
    rows, of = classes(docs)
    return rows.join(of, "node").select("doc_id", "class_id", "class_size", F.col("row").eqNullSafe(F.col("kept_row")).alias("is_kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that stand for their class: one row of each. Of rows equal in doc_id and text
    but not in other columns the one with the smallest hash of all its columns stays."""
    least = F.lit(-(1 << 63))  # for null
    whole = docs.select(F.struct("*").alias("row")).select("row", _node("row.text"), F.coalesce(F.col("row.doc_id").cast("long"), least).alias("own"))
    # Repeated rows are reduced where they are, before texts are dealt out.
    value = lambda f: F.to_json(F.struct(F.col("row")[f.name])) if "map<" in f.dataType.simpleString() else F.col("row")[f.name]
    whole = whole.groupBy("node", "own").agg(F.min_by("row", F.xxhash64(*[x for f in docs.schema.fields for x in (value(f), value(f).isNull())])).alias("row"))
    kept = classes(docs)[1].where("kept_row IS NOT NULL").select("node", F.coalesce("class_id", least).alias("own"))
    return whole.join(kept, ["node", "own"]).select("row.*")
