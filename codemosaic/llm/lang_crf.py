"""Language identification by a linear-chain conditional random field over words.

Every word (a run of letters, lower case) gets a score for each language from hashed n-grams of its bytes between marks of
its ends (those that touch a mark are its affixes, the others inner n-grams) and from a lexicon of words common in the training
texts. Learned transition scores link the languages of neighbouring words, so a text may switch language within.
Forward-backward gives each word's distribution; a document's prediction is the language with the largest expected
share of words, and that share is its score.

Long texts cost no more than their length: the chain is cut into blocks of BLOCK words, whose transfer matrices are
multiplied for all blocks of a batch at once; messages then cross the blocks in order, and each block is finished
from its two ends. The result is that of the plain recursion.

Every language is learned, from a bounded sample: PER_LANGUAGE rows of each, or of more than LANGUAGES languages a share of as many
rows in all (one at least), the smallest by a hash of doc_id and text, texts of up to TEXT_CHARS characters before
longer ones, as long as their characters are at most SAMPLE_CHARS a language. To the texts, whose words all
have the text's language, come texts put together from stretches of several, so that switching is learned as well as staying.

Defined cases: text that is null or has no letter (Unicode category L): ``und``, score 0; ties: the first language by name; without
any training row every text is ``und``; repeated rows each give a row; an empty table gives an empty table; a very long text is one
chain; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_few, crc_mod, materialize, steps, texts_of

PER_LANGUAGE, LANGUAGES, SAMPLE_CHARS, TEXT_CHARS, ROUNDS, RATE, PENALTY = 100, 64, 500_000, 50_000, 30, 0.3, 1e-4
GRAMS, LEXICON, LEXICON_LEAST, BUCKETS, BLOCK = (2, 3, 4), 20_000, 5, 1 << 15, 32

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters; numbers that are no decimal digits (fractions, Roman signs) are no letters."""
    out = _WORD.findall(text.lower())
    if all(map(str.isalpha, out)):
        return out
    return [x for w in out for x in "".join(c if c.isalpha() else " " for c in w).split()]


def gram_ids(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one word after the other, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in own]
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes to the word's end
    ids, word = [], []
    of = np.repeat(np.arange(len(own)), sizes)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        ids.append((h * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64))
        word.append(of[at])
    ids, word = np.concatenate(ids), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    return ids[order], np.searchsorted(word[order], np.arange(len(own)))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # BUCKETS x languages
    lexicon: dict[str, int]
    entries: np.ndarray  # lexicon x languages
    links: np.ndarray  # from x to

    def unary(self, own: list[str]) -> np.ndarray:
        """Scores of each word for each language."""
        if not own:
            return np.empty((0, len(self.languages)))
        ids, starts = gram_ids(own)
        out = np.add.reduceat(self.grams[ids], starts, axis=0)
        at = np.array([self.lexicon.get(w, -1) for w in own])
        out[at >= 0] += self.entries[at[at >= 0]]
        return out


def marginals(scores: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains laid end to end.

    scores: words x labels; sizes: words of each chain (1 or more). Returns each word's distribution, the expected number of
    each transition, and the summed log of the partition functions.
    """
    k = scores.shape[1]
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp(scores - top)
    shift = links.max()
    move = np.exp(links - shift)
    blocks = -(-sizes // BLOCK)
    n_blocks = int(blocks.sum())
    # where each word stands: block, place in it
    chain = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = (np.cumsum(blocks) - blocks)[chain] + place // BLOCK
    e = np.ones((n_blocks, BLOCK, k))
    real = np.zeros((n_blocks, BLOCK), bool)
    e[block, place % BLOCK] = emit
    real[block, place % BLOCK] = True
    first = np.cumsum(blocks) - blocks
    # transfer matrix of each block; a chain's first word is not moved to
    matrix = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    head = np.zeros(n_blocks, bool)
    head[first] = True
    for s in range(BLOCK):
        on = real[:, s]
        if not on.any():
            break
        step = matrix[on] if s else np.where(head[on, None, None], np.eye(k), move)
        if s:
            step = step @ move
        step = step * e[on, s][:, None, :]
        matrix[on] = step / step.max(axis=(1, 2), keepdims=True)
    # messages into each block from the left and from the right
    enter, leave = np.full((n_blocks, k), 1.0 / k), np.ones((n_blocks, k))
    most = int(blocks.max(initial=0))
    for b in range(1, most):
        at = first[blocks > b] + b
        v = np.einsum("ij,ijk->ik", enter[at - 1], matrix[at - 1])
        enter[at] = v / v.sum(axis=1, keepdims=True)
    for b in range(most - 2, -1, -1):
        at = first[blocks > b + 1] + b
        v = np.einsum("ijk,ik->ij", matrix[at + 1], leave[at + 1])
        leave[at] = v / v.sum(axis=1, keepdims=True)
    # within the blocks
    ahead, back = np.empty((n_blocks, BLOCK, k)), np.empty((n_blocks, BLOCK, k))
    logs = np.zeros(n_blocks)
    v = enter
    for s in range(BLOCK):
        w = (v @ move if s else np.where(head[:, None], v, v @ move)) * e[:, s]
        total = w.sum(axis=1, keepdims=True)
        v = np.where(real[:, s, None], w / total, v)
        logs += np.where(real[:, s], np.log(total[:, 0]), 0)
        ahead[:, s] = v
    v = leave
    for s in range(BLOCK - 1, -1, -1):
        back[:, s] = v
        w = (e[:, s] * v) @ move.T
        v = np.where(real[:, s, None], w / w.sum(axis=1, keepdims=True), v)
    belief = ahead * back
    belief /= belief.sum(axis=2, keepdims=True)
    # expected transitions: into every word but a chain's first
    before = np.concatenate([enter[:, None], ahead[:, :-1]], axis=1)
    into = real.copy()
    into[head, 0] = False
    ahead_of, seen = before[into], (e * back)[into]
    total = ((ahead_of @ move) * seen).sum(axis=1, keepdims=True)
    joint = move * ((ahead_of / total).T @ seen)
    value = float(logs.sum() + top.sum() + shift * into.sum() + len(sizes) * np.log(k))
    return belief[block, place % BLOCK], joint, value


def mixtures(texts: list[list[str]], labels: list[str], n: int, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Words and languages of texts put together from stretches of 3 to 20 words of others."""
    r = random.Random(seed)
    out = []
    for _ in range(n if len({*labels}) > 1 else 0):
        own: list[str] = []
        said: list[str] = []
        for _ in range(r.randint(2, 5)):
            k = r.randrange(len(texts))
            start = r.randrange(len(texts[k]))
            part = texts[k][start : start + r.randint(3, 20)]
            own += part
            said += [labels[k]] * len(part)
        out.append((own, said))
    return out


class Corpus:
    """Texts whose words have languages, as arrays, and the gradient of their mean log likelihood a word."""

    def __init__(self, model: Model, texts: list[tuple[list[str], list[str]]], count: Counter):
        self.model, own = model, list(count)
        number, k = {w: i for i, w in enumerate(own)}, len(model.languages)
        language = {y: i for i, y in enumerate(model.languages)}
        self.at = np.array([number[w] for t, _ in texts for w in t])
        self.sizes = np.array([len(t) for t, _ in texts])
        self.gold = np.array([language[y] for _, said in texts for y in said])
        self.ids, self.starts = gram_ids(own)
        self.gram_word = np.repeat(np.arange(len(own)), np.diff([*self.starts, len(self.ids)]))
        self.entry = np.array([model.lexicon.get(w, -1) for w in own])
        self.moves = np.zeros((k, k))
        inner = np.ones(len(self.gold) - 1, bool)
        inner[np.cumsum(self.sizes)[:-1] - 1] = False
        np.add.at(self.moves, (self.gold[:-1][inner], self.gold[1:][inner]), 1)

    def gradient(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
        """By the n-grams, the lexicon and the transitions; and the log likelihood."""
        model, k, n, known = self.model, len(self.model.languages), len(self.at), self.entry >= 0
        scores = np.add.reduceat(model.grams[self.ids], self.starts, axis=0)
        scores[known] += model.entries[self.entry[known]]
        belief, moved, value = marginals(scores[self.at], self.sizes, model.links)
        rest = -belief
        rest[np.arange(n), self.gold] += 1
        by_word = np.stack([np.bincount(self.at, rest[:, c], len(scores)) for c in range(k)], 1)
        grams = np.stack([np.bincount(self.ids, by_word[self.gram_word, c], BUCKETS) for c in range(k)], 1)
        entries = np.zeros_like(model.entries)
        entries[self.entry[known]] = by_word[known]
        said = scores[self.at, self.gold].sum() + (self.moves * model.links).sum() - value
        parts = (model.grams, model.entries, model.links)
        return tuple(g / n - PENALTY * p for p, g in zip(parts, (grams, entries, self.moves - moved), strict=True)), float(said) / n - PENALTY / 2 * sum((p**2).sum() for p in parts)


def fit(texts: list[list[str]], labels: list[str], rounds: int = ROUNDS) -> Model:
    """Full-batch training (adaptive steps) on texts whose words all have the text's language, and on mixtures of them."""
    pairs = [(w, y) for w, y in zip(texts, labels, strict=True) if w]
    languages = sorted({y for _, y in pairs})
    k = len(languages)
    count = Counter(w for t, _ in pairs for w in t)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= LEXICON_LEAST}
    model = Model(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros((max(1, len(lexicon)), k)), np.zeros((k, k)))
    if not pairs or k == 1:
        return model
    mixed = mixtures([w for w, _ in pairs], [y for _, y in pairs], len(pairs))
    corpus = Corpus(model, [(t, [y] * len(t)) for t, y in pairs] + mixed, count)
    parts = (model.grams, model.entries, model.links)
    history = [np.full(p.shape, 1e-8) for p in parts]
    for _ in range(rounds):
        for p, g, h in zip(parts, corpus.gradient()[0], history, strict=True):
            h += g * g
            p += RATE * g / np.sqrt(h)
    return model


class Tagger:
    """Labels texts with a model; keeps the scores of words seen before, up to a bound."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.number: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def beliefs(self, split: list[list[str]]) -> list[np.ndarray | None]:
        """The distribution of each word of each text; None for texts without words."""
        if len(self.number) > self.most:
            self.number, self.scores = {}, self.scores[:0]
        new = list(dict.fromkeys(w for t in split for w in t if w not in self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, self.model.unary(new)])
        sizes = np.array([len(t) for t in split], np.int64)
        at = np.fromiter((self.number[w] for t in split for w in t), np.int64, int(sizes.sum()))
        out: list[np.ndarray | None] = [None] * len(split)
        if not len(at) or not self.model.languages:
            return out
        belief = marginals(self.scores[at], sizes[sizes > 0], self.model.links)[0]
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(sizes).tolist():
            out[i] = belief[ends[i] - sizes[i] : ends[i]]
        return out

    def shares(self, texts: list[str]) -> list[np.ndarray | None]:
        """The expected share of words in each language; None for texts without words."""
        return [None if b is None else b.mean(axis=0) for b in self.beliefs([words(t) for t in texts])]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, text of the training sample: documents whose crc32(doc_id) mod 4 is not 2. Only rows below a hash that about four
    times as many rows of a language are below are sorted, so what is dealt out is bounded by the sample, not by the corpus."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    usable = docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select(F.col("lang").cast("string").alias("lang"), "text", key.alias("key"), F.char_length("text").cast("long").alias("n")).where(F.col("n") <= chars)
    rows = materialize(usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("rows")), "languages")
    share = languages / max(languages, rows.count())
    each = max(1, int(per_language * share))
    common = rows.select("lang", (4 * each / F.greatest("rows", F.lit(1)) * (1 << 30)).cast("long").alias("below"))
    few = usable.join(broadcast_if_few(common, "below"), "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("below"))
    few = few.groupBy("lang", "key").agg(F.min("text").alias("text"), F.min("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n") > TEXT_CHARS, F.pmod("key", F.lit(1 << 30)), "key")
    return few.select("lang", "key", "text", F.row_number().over(order).alias("place"), F.sum("n").over(order).alias("chars")).where((F.col("place") <= each) & (F.col("chars") <= max(1, int(chars * share)))).select("lang", "key", "text")


def train(docs: DataFrame) -> Model:
    got = sorted(sample(docs).collect(), key=lambda r: (r.lang, r.key, r.text))
    return fit([words(r.text) for r in got], [r.lang for r in got])


WORD_LABELS = "doc_id long, words array<struct<word:string,lang:string,share:double>>"


def label_words(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, and its words in order, each with its likeliest language and that one's share."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # of bounded size
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, languages = Tagger(shared.value), shared.value.languages
        for b in steps(batches, "text", most=1 << 20):
            split = [words(t) for t in texts_of(b.column("text"))]
            rows = [[{"word": w, "lang": languages[int(x.argmax())], "share": float(x.max())} for w, x in zip(own, belief, strict=True)] if belief is not None else [] for own, belief in zip(split, tagger.beliefs(split), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, WORD_LABELS)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        languages = shared.value.languages
        for b in steps(batches, "text", most=1 << 20):
            shares = tagger.shares(texts_of(b.column("text")))
            best = [("und", 0.0) if s is None else (languages[int(s.argmax())], float(min(1.0, s.max()))) for s in shares]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
