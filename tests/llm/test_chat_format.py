import hashlib
import random

from codemosaic.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part string"


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(((c, len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), digest("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()), key=repr)


def read(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    formatted = chat_format.format_conversations(df)
    return formatted, sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(formatted).collect()), key=repr)


def test_round_trip(spark):
    r = random.Random(6)
    pieces = ["\\", "<", ">", "</turn>", "<turn assistant>\n", "\n", "é", "\U0001f600", "text ", r"\### Assistant: </turn> ok", "\\<", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "we<i>rd\\>", None]), r.choice([None, "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "assistant", "of no conversation"), (7, None, "user", "before all"), (8, 0, "user", "twice"), (8, 0, "user", "twice")]
    _, got = read(spark, rows)
    assert got == expected(rows)


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "long <text> " * 3000) for t in range(300)] + [(2, 0, "assistant", "x" * 6_000_000), (2, 1, "assistant", "é")]
    formatted, got = read(spark, rows)
    assert got == expected(rows) and max(r.part for r in formatted.collect()) > 0


def test_a_conversation_over_many_partitions(spark, request):
    r = random.Random(3)
    rows = [(1, r.choice([None, 5, k]), r.choice(["assistant", "user", None]), f"said <{k % 90}> {'x' * (k % 70)}") for k in range(1200)] + [(c, 0, "assistant", f"other {c}") for c in range(2, 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    formatted = chat_format.format_conversations(df)
    tasks = {p.part >> 32 for p in formatted.where("conv_id = 1").collect()}
    assert len(tasks) > 1  # split by ranges
    for held in (chat_format.HELD, 200):
        got = sorted(((x.conv_id, x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat_format.read_back(formatted, held).collect()), key=repr)
        assert got == expected(rows)
    ordered = sorted(formatted.where("conv_id = 1").collect(), key=lambda p: p.part)
    assert sum(p.n_turns for p in ordered) == 1200 and all(p.formatted[s.start : s.end].startswith("said \\<") for p in ordered for s in p.loss)


def test_texts_cannot_forge_marks():
    import pyarrow as pa

    out, starts, _, _ = chat_format.assemble(pa.array(["user", "assistant"]), pa.array([r"\### Assistant: </turn> ok", "<turn user>\nx</turn>\n"]))
    text = bytes(out).decode()
    assert text.count("</turn>\n") - text.count("\\</turn>\n") == 2 and len(text.encode()) == starts[-1]
    assert chat_format.parse(text) == [("user", r"\### Assistant: </turn> ok"), ("assistant", "<turn user>\nx</turn>\n")]


def test_empty_table(spark):
    assert read(spark, [])[1] == []
