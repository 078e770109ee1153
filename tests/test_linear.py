"""Extraction and checks in time linear in the file, with the results of the plain patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codemosaic.operators import guard, scanners
from codemosaic.operators.symbols import declarations, imports

# What declarations are, as patterns that read blank lines anew at every line.
PLAIN = {
    "rust": [r"(?m)^\s*(?:pub(?:\([^)]+\))?\s+)?" + x + r"\s+([a-zA-Z_][a-zA-Z0-9_]*)" for x in (r"(?:async\s+)?fn", "struct", "enum", "trait", "type")],
    "typescript": [
        r"(?m)^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
        r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z_$][a-zA-Z0-9_$]*)\s*=>",
        r"(?m)^\s*(?:export\s+(?:default\s+)?)?class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
        r"(?m)^\s*(?:export\s+)?interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
        r"(?m)^\s*(?:export\s+)?type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)",
    ],
    "python": [r"(?m)^\s*(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"(?m)^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)"],
}
WORDS = {
    "rust": ["pub ", "pub(crate) ", "pub(", ")", "async ", "fn ", "fn", "struct ", "enum ", "trait ", "type ", "a", "B1", "(x)", "{", "}", ";", "é"],
    "typescript": ["export ", "default ", "async ", "async", "function ", "const ", "let ", "var ", "class ", "interface ", "type ", "$f", "x", ":", ": T", "=", " = ", "(", ")", "(a, b)", "=>", " => ", "==", ";", "{", "}"],
    "python": ["async ", "def ", "def", "class ", "f", "G2", "(x):", ":", "é", "#"],
}
SPACE = [" ", "\n", "\n\n", "\n  ", "\t", "\r\n", " \n \n", "\x0b", "\u2028"]


@pytest.mark.parametrize("language", PLAIN)
def test_declarations_are_those_of_the_plain_patterns(language):
    r = random.Random(language)
    for _ in range(6000):
        code = "".join(r.choice(WORDS[language]) if r.random() < 0.65 else r.choice(SPACE) for _ in range(r.randint(1, 25)))
        got = [(x[7], x[1], x[4]) for x in declarations("p", language, code)]
        want = [(k, m[1], len(code[: m.start()].encode())) for k, p in enumerate(PLAIN[language]) for m in re.finditer(p, code)]
        assert got == want, repr(code)


def _seconds(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


@pytest.mark.parametrize(
    ("language", "code"),
    [
        *[(lang, "\n" * 100_000) for lang in PLAIN], *[(lang, "x" + "\n \n" * 50_000 + "y") for lang in PLAIN], ("rust", "pub(a\n" * 20_000), ("typescript", "const a: b\n" * 20_000), ("typescript", "const a = (b\n" * 20_000),
        ("python", "class A:\n" * 5_000), ("rust", "fn a\n" * 5_000), ("rust", "/// x\n" * 20_000 + "fn a() {}\n" * 2_000),
    ],
)
def test_extraction_takes_linear_time(language, code):
    assert _seconds(lambda: declarations("p", language, code, False, True)) < 1


def test_unwraps_in_raw_strings_take_linear_time():
    code = 'r#"' + ".unwrap()\n" * 40_000
    assert _seconds(lambda: scanners.first_unguarded_unwrap(code)) < 1 and scanners.first_unguarded_unwrap(code) is None
    assert scanners.first_unguarded_unwrap('r#"a"#.unwrap()') == 6 and scanners.first_unguarded_unwrap('r#"a.unwrap()"#') is None


def test_names_of_a_megabyte(spark):
    """Division and index checks read a long name once."""
    rows = [(1, "a" * 1_000_000), (2, "a1" * 500_000), (3, "a1" * 300_000 + "/b"), (4, "9a" * 100_000 + "[i]"), (5, "x\n" * 300_000)]
    df = spark.createDataFrame(rows, "id int, c string").select("id", guard.division(F.col("c")).alias("d"), guard.array_bounds(F.col("c")).alias("i"))
    df.collect()
    began = time.perf_counter()
    got = {r.id: r for r in df.collect()}
    assert time.perf_counter() - began < 5
    assert [k for k, r in got.items() if r.d] == [3] and [k for k, r in got.items() if r.i] == [4] and got[4].i.startswith("Index at byte 1: `a9a")


def test_checks_are_those_of_the_plain_patterns(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b1", "9", "_x", "/", " / ", "[", "]", " ", "\n", "é", ".", "[ i ]"]) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    for of, plain, word in ((guard.division, r"[a-zA-Z_][a-zA-Z0-9_]*\s*/\s*[a-zA-Z_][a-zA-Z0-9_]*", "Division"), (guard.array_bounds, r"[a-zA-Z_][a-zA-Z0-9_]*\s*\[\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\]", "Index")):
        for row in df.select("c", of(F.col("c")).alias("d")).collect():
            m = re.search(plain, row.c)
            if m and not re.search(r"/\s*[0-9]", row.c):
                assert row.d.startswith(f"{word} at byte {len(row.c[: m.start()].encode())}: `{m[0]}`"), row.c
            elif not m:
                assert row.d is None, row.c


def test_uses_take_linear_time_and_equal_the_plain_pattern(spark):
    r = random.Random(8)
    words = ["use ", "pub use ", "pub ", "a::b", "{c, d}", ";", ";", "\n", "\n\n ", " ", "x", "mod m;", "use", "é"]
    codes = ["".join(r.choice(words) for _ in range(r.randint(1, 20))) for _ in range(1500)]
    rows = [(f"f{i}", "rust", c) for i, c in enumerate(codes)] + [("big", "rust", "use a\n" * 50_000), ("blank", "rust", "\n" * 100_000 + "use z;")]
    got = {}
    began = time.perf_counter()
    for x in imports(spark.createDataFrame(rows, "path string, language string, content string")).orderBy("file", "ord").collect():
        got.setdefault(x.file, []).append(x.target)
    assert time.perf_counter() - began < 20
    for i, c in enumerate(codes):
        uses = [m[1].strip() for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", c)]
        mods = [m[1] + ".rs" for m in re.finditer(r"(?m)^\s*(?:pub\s+)?mod\s+([a-zA-Z_][a-zA-Z0-9_]*);", c)]
        assert got.get(f"f{i}", []) == uses + mods, repr(c)
    assert got["blank"] == ["z"] and "big" not in got
