import random

import pytest

#: Columns whose names the operators use themselves.
EXTRA = ("score", "n_words", "class_id", "row", "c0", "node", "contaminated_by", "spans", "own")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

_SYLLABLES = {"en": ["the", "tion", "ing", "er", "ou", "st", "wh"], "de": ["sch", "ung", "ein", "keit", "pf", "ü"], "fr": ["eau", "oux", "é", "tre", "ment", "qu"]}


def prose(seed: int, words: int, lang: str = "en") -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        out.append("".join(r.choice(_SYLLABLES[lang]) for _ in range(r.randint(1, 4))) + (".\n" if i % 60 == 59 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(EXTRA))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, an empty and a very long text, ties and repeated rows, under extra columns with clashing names."""
    long = "\n".join(prose(s, 400) for s in range(60))
    return [row(1, prose(1, 120)), row(1, prose(1, 120)), row(2, None), row(3, ""), row(3, ""), row(None, prose(1, 120)), row(4, "two words"), row(5, long), row(6, " \n\t\n ", None, None), row(7, prose(7, 90, "de"), "de"), row(7, prose(8, 90, "fr"), "fr"), row(8, "<|endoftext|>  é\U0001f600" * 30)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
