import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codemosaic.llm import bpe_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_digests_equal_the_library(spark, edge_docs, edge_rows, tokenizer):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.round_trip_digests(edge_docs, PATH).collect())
    assert got == sorted(expected(tokenizer, r[1]) for r in edge_rows)


def test_doc_id_of_another_type(spark, tokenizer):
    docs = spark.createDataFrame([(7, "some text"), (None, "é")], "doc_id int, text string")
    assert {r.doc_id: tuple(r)[1:] for r in bpe_chunks.round_trip_digests(docs, PATH).collect()} == {7: expected(tokenizer, "some text"), None: expected(tokenizer, "é")}
    assert {r.doc_id for r in bpe_chunks.encode_documents(docs, PATH).collect()} == {7, None}


def test_a_passage_within_other_texts_is_reused():
    passage = " ".join(f"word{i * 7 % 400}" for i in range(150))
    codec = bpe_chunks.ChunkCodec(PATH)
    for k in range(12):
        codec.encode([" ".join(f"own{k}x{i}" for i in range(60)) + " " + passage + " " + " ".join(f"end{k}x{i}" for i in range(60))])
    assert codec.reused >= 11


def test_empty_table(no_docs):
    assert bpe_chunks.round_trip_digests(no_docs, PATH).count() == 0


def test_joins_in_any_text(tokenizer):
    r = random.Random(5)
    alphabet = ["a", "the ", " ", "  ", "\n", "\t", "é", "中", "'s", "'", "12", "<|endoftext|>", "!!", "***", "x" * 50, "word ", "\r\n", " \n ", "😀", " ", " "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([10, 400, 3000]))) for _ in range(150)] + ["x" * 40000, " " * 30000, "é" * 9000, "<|endoftext|>" * 900]
    codec = bpe_chunks.ChunkCodec(PATH)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.decode_bytes(ids).decode() == text


def test_shared_chunks_are_encoded_once_and_the_store_is_bounded():
    shared = "".join(f"word{i} " for i in range(4000))
    codec = bpe_chunks.ChunkCodec(PATH, store_bytes=400_000)
    codec.encode([shared])
    first = codec.encoded
    codec.encode(["another beginning " + shared])
    assert codec.encoded - first <= 6 and codec.reused > first / 2
    codec.encode(["".join(f"w{i * k} " for i in range(9000)) for k in range(2, 8)])
    assert codec.held <= 210_000 and sum(len(c) + x.nbytes for s in (codec.store, codec.older) for c, x in s.items()) <= 420_000


def test_cuts_lie_on_characters():
    data = np.frombuffer(("é中😀" * 9000).encode(), np.uint8)
    ends = bpe_chunks.cuts(data)
    assert ends[-1] == len(data) and all(e == len(data) or data[e] & 0xC0 != 0x80 for e in ends)


def test_tables_round_trip(spark):
    docs = spark.createDataFrame([(1, "some text, é"), (2, ""), (3, None)], "doc_id long, text string")
    back = bpe_chunks.decode_documents(bpe_chunks.encode_documents(docs, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "some text, é", 2: "", 3: ""}


@pytest.mark.parametrize("one", [" ", "\n", "　", "a", "."])
def test_runs_of_one_character(tokenizer, one):
    """Runs of a million and five million characters, by themselves and within a text."""
    codec = bpe_chunks.ChunkCodec(PATH)
    for text in (one * (5_000_000 if one in " a" else 1_000_000), f"a{one * 1_000_000}b", f"é {one * 1_200_000}<|endoftext|>{one * 200_000} end{one * 3}"):
        ids = codec.encode([text])[0]
        assert np.array_equal(ids, np.array(tokenizer.encode(text, add_special_tokens=False).ids))
        assert codec.decode_bytes(ids) == text.encode()


def test_taking_runs_out_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "LONG_RUN", 3)
    r = random.Random(11)
    alphabet = ["a", "the ", " ", "   ", "\n\n", "\t", "\x1c", "\x85", "\xa0", " ", "é", "'s", "12", "<|endoftext|>", "!!", " \n ", "　"]
    codec = bpe_chunks.ChunkCodec(PATH)
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert codec.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
