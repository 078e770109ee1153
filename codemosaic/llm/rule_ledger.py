"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: ``ledger`` keeps the measurements and one failure bit for each rule. A
policy is a version with a mask of the rules it enforces; applying one, comparing versions and ablating rules are
bitwise operations on the stored bits and never touch the text again.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines are split at line feeds.

Defined cases: null text has no words and no lines, so it fails ``few_words``; a very long text is measured whole; repeated rows each give a row; an empty
table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")

#: Rule name -> SQL condition under which a document fails it. The place in this list is the rule's bit: append only.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("shouting", "100 * n_capitals > 60 * n_letters"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines AND n_dup_lines > 3"),
    ("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policy version -> mask of the rules that it enforces.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"], 3: BASE | BIT["symbols"] | BIT["shouting"]}
CURRENT = 3

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    k = len(known)
    _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for o in range(3):
        covered[o : n - 2 + o] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text."""
    if text is None:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()
    lines = data.split(b"\n")
    worded = [x for x in lines if x.strip()]
    # continuation bytes belong to the code point before them
    bare = data.translate(None, _SPACES)
    chars = len(bare) - int((np.frombuffer(bare, np.uint8) & 0xC0 == 0x80).sum())
    return len(words), chars, len(_SYMBOL.findall(text)), len(worded) - len(set(worded)), repeat_words(words), len(lines), len(_LETTER.findall(text)), len(_CAPITAL.findall(text))


def failure_bits() -> Column:
    """The rules' failures as one integer, from the measurements."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, MEASURES, fail_bits. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = [measure(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", failure_bits())


def apply_policy(stored: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy version."""
    bits = F.col("fail_bits")
    base_failed = bits.bitwiseAND(F.lit(BASE)) != 0
    return stored.withColumns({"base_failed": base_failed, "kept": ~base_failed & (bits.bitwiseAND(F.lit(POLICIES[version])) == 0)})


def ablations(stored: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, and how many it alone rejects (kept if the rule went)."""
    mask = POLICIES[version]
    enforced = F.col("fail_bits").bitwiseAND(F.lit(mask))
    by_bits = stored.groupBy(enforced.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask]))
    per = by_bits.select("bits", "n", rules.alias("r")).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return per.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"))


def summary(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: the rules that any document failed (bitwise or) and that all failed (bitwise and)."""
    return stored.groupBy(*keys).agg(F.bit_or("fail_bits").alias("any_failed"), F.bit_and("fail_bits").alias("all_failed"), F.count(F.lit(1)).alias("n_docs"))
