import re
from collections import Counter

from codemosaic.llm import rule_ledger as rules

from .conftest import SCHEMA, prose, row


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures_equal_brute_force(spark, edge_docs, edge_rows, no_docs):
    texts = ["a b c a b c", "x x x x", "x x x", "a b\na b\n\n \na b", "é ü\u00a0ß <tag> #1", "\u2003a\u2028b c", "a\rb\x0bc", prose(3, 300) + prose(3, 300)]
    docs = edge_docs.union(spark.createDataFrame([row(100 + i, t) for i, t in enumerate(texts)], SCHEMA))
    got = rules.apply_policy(rules.ledger(docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(((x[0], *brute(x[1])) for x in [*edge_rows, *[(100 + i, t) for i, t in enumerate(texts)]]), key=repr)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert rules.ledger(no_docs).count() == 0


def test_policies_and_ablations_are_bitwise(spark):
    texts = [prose(i, 80) for i in range(6)] + [" ".join(w + "***" for w in prose(9, 80).split()), prose(10, 80).upper(), "few words", "x x x x " * 40, ("y y y*** " * 40).upper()]
    stored = rules.ledger(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).cache()
    kept = {v: {r.doc_id for r in rules.apply_policy(stored, v).collect() if r.kept} for v in rules.POLICIES}
    assert kept[1] > kept[2] > kept[3] == set(range(6))
    told = {r.rule: (r.n_failed, r.n_alone) for r in rules.ablations(stored, 3).collect()}
    assert told["few_words"] == (1, 1) and told["symbols"][1] == 1 and told["shouting"] == (2, 1) and told["repeated_words"] == (2, 1)
    whole = rules.summary(stored, []).first()
    assert whole.any_failed & rules.BIT["symbols"] and whole.all_failed == 0 and whole.n_docs == len(texts)
