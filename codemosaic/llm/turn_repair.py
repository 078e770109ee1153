"""Conversation structure repair by shortest paths with Dial's bucket queue.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its turns are edited at least cost: Keep 0,
Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5; a truncated turn that is not deleted adds
5; blank and duplicate turns must be deleted. The audit is the edits' initials in order, the least in ASCII order of the cheapest.

A node is (turns taken, state of the pattern); each edit is an arc with a small integer cost, and a node has at most one arc of
each initial. Dial's queue, a ring of one bucket for each possible arc cost, gives the distance of every node to the goal;
from the start the walk takes the least initial whose arc is tight, which is the audit.

1. Equal turns (conv_id, turn, role, text) become one row with their number before anything moves; the first place of each
   (role, text) of a conversation is an aggregate, so a turn knows whether an equal one came before.
2. Turns are dealt out by ranges of their order, so many tasks share a long conversation. One that lies within a
   partition and within a block is solved there. Others come as blocks: for each state at its begin and its end, the
   least cost and its audit; a block's row holds no more than BLOCK_TURNS turns and BLOCK_BYTES of text (or one turn).
3. Blocks are chained by their 16 costs, backward for distances and forward for the walk. Audits of one block that lead to
   different states differ before either ends, so comparing them block by block is comparing the whole.
4. The edits of each block are applied where its texts are.

Of a long conversation one task holds the costs and audits of all blocks, never the texts.

Defined cases: null role, text: one space; null conv_id is a conversation of its own, null turn comes first; turns that tie on
conv_id and turn follow by role and text; a role whose initial fits no state is reroled or deleted; an empty role has no
initial; a repeated row is a duplicate turn; a very long text is a block by itself; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, keep_nothing, materialize, steps

BLOCK_TURNS, BLOCK_BYTES = 4096, 1 << 20
#: Characters of a text that decide, with the columns before it, where a range ends.
PREFIX = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The pattern may end in 0 and 3.
_FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)  # where an inserted or reroled turn leads
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}
_RING = REROLE + TRUNCATED + 1  # one more than the dearest arc
_FAR = 1 << 60

#: What a turn is: its initial, whether it must go, whether it is truncated.
Turn = tuple[str, bool, bool]


def _arcs(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state) of the edits that take a turn, by initial."""
    initial, goes, truncated = turn
    out = [("D", DELETE, state)]
    if not goes:
        more = TRUNCATED if truncated else 0
        if (state, initial) in _FITS:
            out.append(("K", KEEP + more, _FITS[state, initial]))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def distances(turns: list[Turn], goals: tuple[int, ...], at_end: bool) -> list[int]:
    """The cost from each node (4 * turns taken + state) to the end in one of the goal states; inserts after the last turn
    count if ``at_end``. Dial's queue: nodes wait in the bucket of their distance modulo the ring's size."""
    n = len(turns)
    cost = [_FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(_RING)]
    for q in goals:
        cost[4 * n + q] = 0
        ring[0].append(4 * n + q)
    into: dict[Turn, list[list[tuple[int, int]]]] = {}  # of a kind of turn, the arcs into each state
    for t in turns:
        if t not in into:
            into[t] = [[] for _ in range(4)]
            for q in range(4):
                for _, w, r in _arcs(t, q):
                    into[t][r].append((q, w))
    inserted = [[q for q in range(4) if _NEXT[q] == r] for r in range(4)]
    waiting, now = len(goals), 0
    while waiting:
        bucket = ring[now % _RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if cost[node] != now:
                continue  # it was reached more cheaply
            i, q = divmod(node, 4)
            found = [(4 * (i - 1) + p, w) for p, w in into[turns[i - 1]][q]] if i else []
            if i < n or at_end:
                found += [(4 * i + p, INSERT) for p in inserted[q]]
            for before, w in found:
                if now + w < cost[before]:
                    cost[before] = now + w
                    ring[(now + w) % _RING].append(before)
                    waiting += 1
        now += 1
    return cost


def audit_of(turns: list[Turn], cost: list[int], state: int, at_end: bool) -> str:
    """The least walk over tight arcs from a state before the first turn."""
    out, i, n = [], 0, len(turns)
    while i < n or at_end and cost[4 * i + state]:
        arcs = [(a, w, i + 1, r) for a, w, r in _arcs(turns[i], state)] if i < n else []
        if i < n or at_end:
            arcs.append(("I", INSERT, i, _NEXT[state]))
        left = cost[4 * i + state]
        edit, _, i, state = min(x for x in arcs if x[1] + cost[4 * x[2] + x[3]] == left)
        out.append(edit)
    return "".join(out)


def apply_audit(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that an audit leaves, from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], ""))
            continue
        if edit == "K":
            state = _FITS[state, roles[i][:1]]
            out.append((roles[i], texts[i]))
        elif edit == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], texts[i]))
        i += 1
    return out


def solve(turns: list[Turn]) -> tuple[int, str]:
    """The least cost of a whole conversation, and its audit."""
    cost = distances(turns, (0, 3), True)
    return cost[0], audit_of(turns, cost, 0, True)


def block_ways(turns: list[Turn]) -> tuple[list[int], list[str]]:
    """For each state before (4 *) and after a block: the least cost, -1 if there is none, and its audit."""
    costs, audits = [-1] * 16, [""] * 16
    for after in range(4):
        cost = distances(turns, (after,), False)
        for before in range(4):
            if cost[before] < _FAR:
                costs[4 * before + after] = cost[before]
                audits[4 * before + after] = audit_of(turns, cost, before, False)
    return costs, audits


#: What may follow the last turn, by state.
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def chain(blocks: list[tuple[list[int], list[str]]]) -> list[tuple[int, int, str]]:
    """The state before each block, the cost and the audit of it, on the least of the cheapest ways through all."""
    left = [[c for c, _ in _END]]
    for costs, _ in reversed(blocks):
        left.append([min((costs[4 * q + r] + left[-1][r] for r in range(4) if costs[4 * q + r] >= 0), default=_FAR) for q in range(4)])
    left.reverse()
    out, state = [], 0
    for i, (costs, audits) in enumerate(blocks):
        tight = [(audits[4 * state + r], r) for r in range(4) if costs[4 * state + r] >= 0 and costs[4 * state + r] + left[i + 1][r] == left[i][state]]
        audit, after = min(tight)
        out.append((state, costs[4 * state + after], audit))
        state = after
    if out:
        more, edits = _END[state]
        out[-1] = (out[-1][0], out[-1][1] + more, out[-1][2] + edits)
    return out


_TURNS = "array<struct<role:string,text:string>>"
#: A conversation's part: what is wrong with its turns, the edits, and the turns that are left. The parts of a conversation by ``block``.
PARTS = f"conv_id long, block long, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired {_TURNS}"
_BLOCKS = f"{PARTS}, first string, last string, costs array<long>, audits array<string>, turns {_TURNS}"
_PAIR = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), _TURNS: _PAIR}


def _batches(rows: Iterator[tuple], schema: str, texts: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``texts`` is the column of turns."""
    fields = [c.split(" ") for c in schema.split(", ")]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for x, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for r in rows:
        held.append(r)
        size += sum(len(x["text"] or "") for x in r[texts] or ()) + 200
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Open:
    """The turns of a conversation that are read but not yet solved."""

    def __init__(self, before: str | None):
        self.before = before  # the initial of the turn before, if it was in this task
        self.turns: list[Turn] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first: str | None = None

    def add(self, role: str, text: str, seen: bool) -> None:
        initial, said = role[:1], text.strip("\x20\t\n\v\f\r")
        truncated = False
        if not said:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif said[-1] not in ".!?":
            self.truncated += 1
            truncated = True
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        self.first = initial if self.first is None else self.first
        goes = not said or seen
        self.turns.append((initial, goes, truncated))
        self.roles.append(role)
        self.texts.append("" if goes else text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.turns) >= BLOCK_TURNS or self.size >= BLOCK_BYTES

    def faults(self) -> tuple[int, int, int, int]:
        return self.blank, self.duplicate, self.truncated, self.illegal

    def whole(self, conv_id: int | None, block: int) -> tuple:
        cost, audit = solve(self.turns)
        left = [{"role": r, "text": t} for r, t in apply_audit(audit, 0, self.roles, self.texts)]
        return (conv_id, block, True, *self.faults(), cost, audit, left, None, None, None, None, None)

    def part(self, conv_id: int | None, block: int) -> tuple:
        costs, audits = block_ways(self.turns)
        return (conv_id, block, False, *self.faults(), None, None, None, self.first, self.before, costs, audits, [{"role": r, "text": t} for r, t in zip(self.roles, self.texts, strict=True)])


def _solve_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie within the partition and a block, solved; blocks of the others."""
    keep_nothing()

    def rows() -> Iterator[tuple]:
        block = TaskContext.get().partitionId() << 32  # ranges are in order, and blocks within them
        now, open_, cut, inner = None, None, False, False
        for b in (s for x in batches for s in steps(iter([x]), "text")):
            for conv_id, role, text, times, seen in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "times", "seen")), strict=True):
                if open_ is None or conv_id != now:
                    if open_ is not None:
                        if open_.turns:
                            yield open_.whole(now, block) if inner and not cut else open_.part(now, block)
                            block += 1
                        inner = True
                    now, open_, cut = conv_id, _Open(None), False
                for k in range(times):
                    open_.add(role, text, seen or k > 0)
                    if open_.full():
                        yield open_.part(now, block)
                        block += 1
                        open_, cut = _Open(None), True
        if open_ is not None and open_.turns:
            yield open_.part(now, block)  # it may go on in the next partition

    return _batches(rows(), _BLOCKS, 14)


_WAYS = "conv_id long, block long, before long, illegal long, cost long, audit string"


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through each block, and the illegal pair between it and the one before; rows by conv_id and block."""

    def ways(conv_id: int | None, own: list[tuple]) -> Iterator[tuple]:
        last = None
        for (block, first, end, _, _), (before, cost, audit) in zip(own, chain([(c, a) for *_, c, a in own]), strict=True):
            yield conv_id, block, before, int(last is not None and last + first not in _LEGAL), cost, audit
            last = end

    def rows() -> Iterator[tuple]:
        now, own = None, []
        for b in batches:
            for conv_id, *more in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "first", "last", "costs", "audits")), strict=True):
                if own and conv_id != now:
                    yield from ways(now, own)
                    own = []
                now = conv_id
                own.append(tuple(more))
        if own:
            yield from ways(now, own)

    names = [c.split()[0] for c in _WAYS.split(", ")]
    held: list[tuple] = []
    for r in rows():
        held.append(r)
        if len(held) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "audit" else pa.int64()) for x, n in zip(zip(*held, strict=True), names, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n == "audit" else pa.int64()) for x, n in zip(zip(*held, strict=True), names, strict=True)], names)


def _apply_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for *more, before, audit, turns in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "blank", "duplicate", "truncated", "illegal", "cost", "before", "audit", "turns")), strict=True):
                left = apply_audit(audit, before, [t["role"] for t in turns], [t["text"] for t in turns])
                yield (*more[:2], False, *more[2:], audit, [{"role": r, "text": t} for r, t in left])

    return _batches(rows(), PARTS, 9)


def repair(turns: DataFrame) -> DataFrame:
    """Parts (PARTS) of conversations(conv_id, turn, role, text); ``whole`` marks a conversation of one part. A conversation
    without turns has none."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    rows = materialize(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times")), "turns")
    said = rows.select("*", F.sha2("text", 256).alias("said"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = said.groupBy("conv_id", "role", "said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    seen = said.join(broadcast_if_few(again, "again"), same, "left").select("conv_id", "turn", "role", "text", "times", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"))
    ranged = seen.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    near = materialize(ranged.select("conv_id", "role", "text", "times", "seen").mapInArrow(_solve_near, _BLOCKS), "near")
    blocks = near.where("NOT whole")
    slim = blocks.select("conv_id", "block", "first", "last", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    ways = slim.mapInArrow(_chain_blocks, _WAYS).select("block", "before", F.col("illegal").alias("between"), F.col("cost").alias("paid"), F.col("audit").alias("edits"))
    chosen = blocks.join(ways, "block").select("conv_id", "block", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), F.col("paid").alias("cost"), "before", F.col("edits").alias("audit"), "turns")
    names = [c.split(" ")[0] for c in PARTS.split(", ")]
    return near.where("whole").select(*names).unionByName(chosen.mapInArrow(_apply_ways, PARTS))


DIGESTS = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, of its parts in order; turns are hashed as they come."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def done(conv_id: int | None, sums: list[int], audit: list[str], digest: object) -> pa.RecordBatch:
        row = (conv_id, *sums, "".join(audit), digest.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i < 6 else pa.string()) for i, x in enumerate(row)], names)

    now, sums, audit, digest, some = None, None, [], None, False
    for b in (s for x in batches for s in (x.slice(i, 1) for i in range(x.num_rows))):
        conv_id, *counts, edits, turns = (b.column(c)[0].as_py() for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"))
        if sums is not None and conv_id != now:
            yield done(now, sums, audit, digest)
            sums = None
        if sums is None:
            now, sums, audit, digest, some = conv_id, [0] * 5, [], hashlib.sha256(), False
        sums = [a + c for a, c in zip(sums, counts, strict=True)]
        audit.append(edits)
        for t in turns:
            digest.update(f"{chr(10) if some else ''}{t['role']}:{t['text']}".encode())
            some = True
    if sums is not None:
        yield done(now, sums, audit, digest)


def digests(parts: DataFrame) -> DataFrame:
    """DIGESTS of what repair() gives: sums over a conversation's parts, its audit, and the hash of its turns as role:text lines."""
    lines = F.expr("array_join(transform(repaired, t -> concat(t.role, ':', t.text)), '\\n')")
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    whole = parts.where("whole").withColumn("repaired_sha256", F.sha2(lines, 256)).select(*names)
    split = parts.where("NOT whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(split.mapInArrow(_digest_parts, DIGESTS))
