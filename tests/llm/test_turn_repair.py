import hashlib
import itertools
import random
import re
import zlib

import pytest

from codemosaic.llm import turn_repair
from codemosaic.llm.queries import damaged_turns, repair_report

SCHEMA = "conv_id long, turn long, role string, text string, block string, audit string"
PATTERN = re.compile(r"(s?(ua)+)?")


def brute_solve(turns):
    """Every sequence of edits, by cost, then audit: at most two inserts before each turn and at the end."""
    best, gaps = None, ["", "u", "a", "ua", "au"]
    choices = []
    for initial, goes, truncated in turns:
        more = 5 if truncated else 0
        own = [("D", 2, "")]
        if not goes:
            own += [("K", more, initial), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        choices.append(own)
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, put))
            if best and cost > best[0]:
                continue
            roles = put[0] + "".join(e[2] + p for e, p in zip(edits, put[1:], strict=True))
            if any(e[0] == "K" and not e[2] for e in edits) or not PATTERN.fullmatch(roles):
                continue
            audit = "I" * len(put[0]) + "".join(e[0] + "I" * len(p) for e, p in zip(edits, put[1:], strict=True))
            if not best or (cost, audit) < best:
                best = cost, audit
    return best


def brute_report(rows):
    """The contract's rows, by a plain fold over each conversation: for each state the least (cost, audit, turns)."""
    out, by = {}, {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t[0] for t in own if t[0] is not None]
        counts, seen, turns = [0] * 4, set(), []
        for i, (_, role, text) in enumerate(own):
            said = text.strip(" \t\n\v\f\r")
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            if i and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                counts[3] += 1
            turns.append((role, text, fault < 2, 5 * (fault == 2)))
        step = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

        def inserted(ways, step=step):
            for _ in range(3):
                for q, (cost, audit, left) in list(ways.items()):
                    r, role = step[q]
                    new = (cost + 5, audit + "I", (*left, f"{role}:"))
                    ways[r] = min(ways.get(r, new), new)
            return ways

        ways = {0: (0, "", ())}
        for role, text, goes, more in turns:
            new = {}

            def put(q, way, new=new):
                new[q] = min(new.get(q, way), way)

            for q, (cost, audit, left) in inserted(ways).items():
                put(q, (cost + 2, audit + "D", left))
                if not goes:
                    fits = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                    if fits:
                        put(fits, (cost + more, audit + "K", (*left, f"{role}:{text}")))
                    r, other = step[q]
                    put(r, (cost + 1 + more, audit + "R", (*left, f"{other}:{text}")))
            ways = new
        cost, audit, left = min(w for q, w in inserted(ways).items() if q in (0, 3))
        gaps = max(known) - min(known) + 1 - len({*known}) if known else 0
        out[conv] = (conv, gaps, *counts, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def conversation(r, conv, n):
    roles = ["user", "assistant"] * (n // 2 + 1)
    rows = []
    for i in range(n):
        role = r.choice(["system", "tool", "", None, "user", "assistant"]) if r.random() < 0.2 else roles[i]
        text = r.choice(["ok.", "Yes!", "what", "", " \t\n", None, "So?  \n", "é…", f"said {r.randrange(6)}."])
        rows.append((conv, r.choice([i, i, i, None, i + 1]), role, text, "x", "y"))
    return rows


def test_solve_equals_brute_force():
    r = random.Random(4)
    for _ in range(120):
        turns = [(r.choice(["s", "u", "a", "u", "a", "t", ""]), r.random() < 0.2, r.random() < 0.25) for _ in range(r.randint(0, 4))]
        turns = [(i, g, t and not g) for i, g, t in turns]
        assert turn_repair.solve(turns) == brute_solve(turns)


def test_chained_blocks_equal_the_whole():
    r = random.Random(9)
    for _ in range(300):
        turns = [(r.choice("suaut"), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(1, 14))]
        cuts = sorted(r.sample(range(len(turns) + 1), min(len(turns), 3)))
        blocks = [turns[a:z] for a, z in zip([0, *cuts], [*cuts, len(turns)], strict=True) if z > a]
        ways = turn_repair.chain([turn_repair.block_ways(b) for b in blocks])
        assert (sum(c for _, c, _ in ways), "".join(a for *_, a in ways)) == turn_repair.solve(turns)


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_query_equals_brute_force(spark, monkeypatch, block):
    r = random.Random(6)
    rows = [x for c in range(120) for x in conversation(r, c if c % 17 else None, r.randint(1, 12))]
    if block < 4096:  # set in the workers as well
        solve = turn_repair._solve_near

        def small(batches, solve=solve, block=block):
            turn_repair.BLOCK_TURNS = block
            try:
                yield from solve(batches)
            finally:
                turn_repair.BLOCK_TURNS = 4096

        monkeypatch.setattr(turn_repair, "_solve_near", small)
    got = repair_report(damaged_turns(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {x.conv_id: tuple(x) for x in got} == brute_report(rows) and len(got) == len({x[0] for x in rows})


def test_edges(spark):
    assert repair_report(damaged_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "gone.", "", ""), (None, None, None, None, "", ""), (6, 1, "user", "word. " * 400_000, "", ""), (6, 2, "assistant", "Same.", "", ""), (6, 2, "assistant", "Same.", "", "")]
    got = {x.conv_id: tuple(x) for x in repair_report(damaged_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute_report(rows)
    assert got[5] == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    """Most rows in one conversation: many tasks share it."""
    r = random.Random(1)
    rows = [x for x in conversation(r, 1, 20_000)] + [x for c in range(2, 40) for x in conversation(r, c, 6)]
    damaged = damaged_turns(spark.createDataFrame(rows, SCHEMA))
    parts = turn_repair.repair(damaged.where("n > 0").drop("n"))
    assert parts.where("conv_id = 1").count() >= 4
    got = {x.conv_id: tuple(x) for x in repair_report(damaged).collect()}
    assert got == brute_report(rows)
