"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: the text between the borders that block tags set, with the tags (and their class and id words) that stand open
around it. Features of ancestors and of the text give each block a score for main text, learned transition scores link
neighbouring blocks, and Viterbi decodes the page. Weights are trained by forward-backward on labelled pages that
``html_pages`` makes by rule from a seed, PAGES of them, once per application on the driver.

Nothing is dropped or capped: an opening ``p`` or ``li`` closes an open one, a closing tag that nothing opened is passed over,
whatever is open at the end is closed. Contents of script, style, template, noscript (and comments, declarations) are no text.
Character references are decoded, white space inside a block becomes one space, blocks are trimmed; empty ones do not count.

Names count as whole words, and only those of containers that hold less than the page's article: what stands around its
``h1``, ``main`` or first ``article`` (and on ``html`` and ``body``) names the page's layout. Reader comments are told by names of
their container, by articles within an article, by a heading that is nothing but a learned word for them and a number, and by structure: containers
of one kind in a row that each hold a line of their own (a writer, a time, a link to reply) beside text. Nothing but made
pages teaches which; these have misleading names and headings as well. Comments that give no such sign inside the main
container cannot be told from its text.

Defined cases: null or empty html, or a page without main text: the empty text; repeated rows each give a row; an empty table gives
an empty table; a very long page is one page, scanned in one pass; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, texts_of
from .html_pages import page

PAGES, ROUNDS, RATE, PENALTY = 600, 250, 0.3, 1e-5
#: Containers around a block whose names, headings and likes are its features.
NEAR = 32

_TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*))")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
#: Words of a name: runs of letters, cut where a capital follows a small letter.
_TOKENS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TITLE = re.compile(r"[^\W\d_]+")
_MUTE = frozenset(("script", "style", "template", "noscript", "iframe", "svg", "textarea"))
_MUTE_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in _MUTE}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first closes an open one of the second kind, if none of the third stands between.
_CLOSES = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


_NAMING = frozenset(("class", "id", "role"))
_HEADINGS = frozenset(("h2", "h3", "h4", "h5", "h6"))
class Container:
    """An open tag: its name, the words that name it, the container around it, and what was seen of it."""

    __slots__ = ("blocks", "heading", "holds_article", "kind", "like", "parent", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Container | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.holds_article = False
        self.heading: tuple[str, ...] = ()  # of what follows in this container
        self.blocks = 0
        self.kind = (tag, words)
        self.like: dict[tuple, int] = {}  # how many containers of each kind with several blocks are in it


class Block:
    """A leaf block: its text, the keys of the tags open around it, its container, the words of the heading over it, and how many of
    its characters are in links."""

    __slots__ = ("anchored", "around", "container", "heading", "inner", "text")

    def __init__(self, text: str, around: tuple[str, ...], inner: str, anchored: int, container: Container | None):
        self.text, self.around, self.inner, self.anchored, self.container = text, around, inner, anchored, container
        self.heading = next((c.heading for c in _up(container, NEAR) if c.heading), ())


def _up(container: Container | None, most: int | None = None) -> Iterator[Container]:
    """A container and those around it, so many at most."""
    while container is not None and most != 0:
        yield container
        container = container.parent
        most = most and most - 1


class Scanner:
    """The tags of a page, in one pass: whatever quotes stand open, no character is looked at more than a few times."""

    def __init__(self, source: str):
        self.source, self.unquoted = source, set()

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """The naming attributes from here, where the tag ends, and whether it closes itself. A quote opens a value only
        where the value begins; one that is never closed is a character of a bare value."""
        source, n = self.source, len(self.source)
        out = []
        while True:
            at = _BETWEEN.match(source, at).end()
            if at >= n:
                return out, n, False
            if source[at] == ">":
                return out, at + 1, source[at - 1] == "/"
            m = _ATTRIBUTE.match(source, at)
            at, value = m.end(), ""
            if m[2] and at < n:
                end, quote = -1, source[at]
                if quote in "\"'" and quote not in self.unquoted:
                    end = source.find(quote, at + 1)
                    if end < 0:
                        self.unquoted.add(quote)  # nor is any later one
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(source, at)
                    value, at = bare[0], bare.end()
            if (name := m[1].lower()) in _NAMING:
                out.append((name, value))

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, list[tuple[str, str]], bool]]:
        """(start, end, whether it is an end tag, name or "" for comments and declarations, naming attributes, self-closed); send
        a position to go on from there."""
        source, at = self.source, 0
        while m := _TAG.search(source, at):
            named, closed = [], False
            if m[1]:
                end = source.find("-->", m.end())
                at = len(source) if end < 0 else end + 3
            elif m[3] is None:
                end = source.find(">", m.end())
                at = len(source) if end < 0 else end + 1
            else:
                named, at, closed = self.attributes(m.end())
            further = yield m.start(), at, bool(m[2]), (m[3] or "").lower(), named, closed
            if further is not None:
                at = further


def leaf_blocks(source: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, Container]] = []  # open tags
    first_article = True
    around: dict[str, int] = {}
    outer: list[int] = []  # where in the stack block tags are
    inline: list[dict[str, int]] = [{}]  # open inline tags: before the first block tag, and in each
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    no_end: set[str] = set()
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inner, container = stack[outer[-1]] if outer else ("", None)
                twice = ("twice=article",) if open_tags.get("article", 0) > 1 else ()
                out.append(Block(text, (*around, *twice), inner, linked, container))
                if inner in _HEADINGS and len(outer) > 1:  # what follows in the same container is under this heading
                    stack[outer[-2]][1].heading = tuple(_TITLE.findall(text.lower()[:60]))
                # Each container counts the kinds of those in it that hold several blocks.
                for c in _up(container):
                    c.blocks += 1
                    if c.blocks == 2 and c.parent is not None:
                        c.parent.like[c.kind] = c.parent.like.get(c.kind, 0) + 1
                    if c.blocks > 2:
                        break
            parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        while len(stack) > i:
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            if not open_tags[tag]:
                del around[f"in={tag}"]
            if tag in _INLINE:
                inline[-1][tag] -= 1
            else:
                outer.pop()
                inline.pop()

    def find(tags: Iterable[str], stops: Iterable[str] = ()) -> int | None:
        """Where the last open one of these tags is, if none of the others stands between."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in stops:
                    return None
        return None

    def say(text: str) -> None:
        nonlocal linked
        parts.append(html.unescape(text) if "&" in text else text)
        linked += len(text) * (open_tags.get("a", 0) > 0)

    tags, at = iter(Scanner(source)), 0
    token = next(tags, None)
    while token:
        start, end, closing, tag, named, closed = token
        if start > at:
            say(source[at:start])
        at = end
        further = None
        if not tag:
            pass
        elif closing:
            if tag in _INLINE:  # an inline end does not close blocks
                i = find((tag,)) if inline[-1].get(tag) else None
            else:
                close_block()
                i = find((tag,))
            if i is not None:
                pop_to(i)
        elif tag in _MUTE:
            if tag != "svg":
                close_block()
            if not (tag == "svg" and closed):  # of foreign content a tag may close itself
                stop = None if tag in no_end else _MUTE_END[tag].search(source, at)
                if stop:
                    at = further = stop.end()
                elif tag == "svg":
                    no_end.add(tag)  # one that nothing closes hides no text
                else:
                    at = further = len(source)
        else:
            if tag == "br":
                parts.append(" ")
            elif tag not in _INLINE:
                close_block()
            if tag not in _VOID:
                if tag in _ENDS_P:
                    if outer and stack[outer[-1]][0] == "p":
                        pop_to(outer[-1])
                elif tag in _CLOSES:
                    ends, stops = _CLOSES[tag]
                    i = find(ends.split(), stops)
                    if i is not None:
                        pop_to(i)
                words = tuple(dict.fromkeys(w.lower() for _, value in named for w in _TOKENS.findall(value)))
                parent = stack[-1][1] if stack else None
                stack.append((tag, Container(tag, words, parent)))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                around[f"in={tag}"] = 1
                if tag in ("h1", "main") or tag == "article" and first_article:
                    first_article = first_article and tag != "article"
                    for c in _up(parent):
                        if c.holds_article:
                            break
                        c.holds_article = True
                if tag in _INLINE:
                    inline[-1][tag] = inline[-1].get(tag, 0) + 1
                else:
                    outer.append(len(stack) - 1)
                    inline.append({})
        try:
            token = tags.send(further)
        except StopIteration:
            token = None
    if at < len(source):
        say(source[at:])
    close_block()
    return out


def block_features(b: Block) -> list[str]:
    text, n = b.text, len(b.text)
    out = ["bias", *b.around, f"tag={b.inner}"]
    names = {w for c in _up(b.container, NEAR) if not c.holds_article and c.tag not in ("html", "body") for w in c.words}
    out += [f"named={w}" for w in sorted(names)]
    if 0 < len(b.heading) <= 3:
        # A heading speaks for what is under it if it is one word, beside small words and numbers.
        out += [f"under={w}" for w in b.heading if len(b.heading) == 1] + [f"under={len(b.heading)}={w}" for w in b.heading if len(b.heading) > 1]
    repeated = next((c for c in _up(b.container, NEAR) if c.parent is not None and c.tag != "p" and not c.holds_article and c.blocks > 1 and c.parent.like.get(c.kind, 0) > 1), None)
    if repeated:
        out += [f"repeated={repeated.tag}", "repeated"]
    out += [f"size={min(9, n.bit_length())}", f"linked={min(3, 4 * b.anchored // max(1, n))}", f"ends={text[-1] in '.!?'}", f"copyright={'©' in text}"]
    if n <= 60 and b.inner in _HEADINGS:
        said = _TITLE.findall(text.lower())
        if len(said) <= 3:
            out += [f"says={len(said)}={w}" for w in said]
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    rows = [block_features(b) for b in blocks]
    if rows:
        rows[0].append("first")
        rows[-1].append("last")
    return rows


class Model:
    """weights: what a feature adds to main text; links: scores of (not main, main) after (not main, main)."""

    def __init__(self, weights: dict[str, float], links: np.ndarray):
        self.weights, self.links = weights, links

    def scores(self, rows: Iterable[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, scores: list[float]) -> list[int]:
        """The likeliest labels of a page's blocks; ties go to not main."""
        if not scores:
            return []
        (nn, nm), (mn, mm) = self.links.tolist()
        no, yes, back = 0.0, scores[0], []
        for s in scores[1:]:
            back.append((no + nn < yes + mn, no + nm < yes + mm))
            no, yes = max(no + nn, yes + mn), max(no + nm, yes + mm) + s
        out = [int(yes > no)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


class Chains:
    """Labelled pages as arrays, padded to the longest, and the gradient of their mean log likelihood a block."""

    def __init__(self, pages: list[tuple[list[list[str]], list[int]]]):
        self.names = sorted({f for rows, _ in pages for row in rows for f in row})
        number = {f: i for i, f in enumerate(self.names)}
        sizes = np.array([len(rows) for rows, _ in pages])
        self.shape = count, most = len(pages), int(sizes.max())
        self.where = np.concatenate([np.full(len(row), p * most + i) for p, (rows, _) in enumerate(pages) for i, row in enumerate(rows)])
        self.ids = np.array([number[f] for rows, _ in pages for row in rows for f in row])
        self.real = np.arange(most)[None, :] < sizes[:, None]
        self.gold = np.zeros((count, most), int)
        for p, (_, y) in enumerate(pages):
            self.gold[p, : len(y)] = y
        self.told = np.zeros((2, 2))
        np.add.at(self.told, (self.gold[:, :-1][self.real[:, 1:]], self.gold[:, 1:][self.real[:, 1:]]), 1)

    def gradient(self, w: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (count, most), real = self.shape, self.real
        unary = np.zeros((count, most, 2))
        unary[:, :, 1] = np.bincount(self.where, w[self.ids], count * most).reshape(count, most)
        a, b = np.zeros((count, most, 2)), np.zeros((count, most, 2))
        a[:, 0] = unary[:, 0]
        for t in range(1, most):
            a[:, t] = np.where(real[:, t, None], unary[:, t] + np.logaddexp(a[:, t - 1, :1] + links[0], a[:, t - 1, 1:] + links[1]), a[:, t - 1])
        for t in range(most - 2, -1, -1):
            x = unary[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(real[:, t + 1, None], np.logaddexp(x[:, :1] + links[:, 0], x[:, 1:] + links[:, 1]), 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        main = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * real
        pair = np.exp(a[:, :-1, :, None] + links + (unary + b)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        rest = ((self.gold - main) * real).ravel()
        found = (np.bincount(self.ids, rest[self.where], len(self.names)), self.told - pair.sum(axis=(0, 1)))
        return tuple(g / real.sum() - PENALTY * p for p, g in zip((w, links), found, strict=True))


def gradient(pages: list[tuple[list[list[str]], list[int]]], model: Model) -> tuple[dict[str, float], np.ndarray]:
    chains = Chains(pages)
    w, links = chains.gradient(np.array([model.weights[f] for f in chains.names]), model.links)
    return dict(zip(chains.names, w.tolist(), strict=True)), links


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS) -> Model:
    """Full-batch training (adaptive steps) of the binary chain by forward-backward, all pages at once."""
    chains = Chains(pages)
    parts = (np.zeros(len(chains.names)), np.zeros((2, 2)))
    history = [np.full(p.shape, 1e-8) for p in parts]
    for _ in range(rounds):
        for p, g, h in zip(parts, chains.gradient(*parts), history, strict=True):
            h += g * g
            p += RATE * g / np.sqrt(h)
    return Model(dict(zip(chains.names, parts[0].tolist(), strict=True)), parts[1])


def labelled_pages(n: int, first_seed: int = 0) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of made pages; a page whose blocks the parser cuts otherwise than they were made is passed over."""
    out = []
    for seed in range(first_seed, first_seed + n):
        made = page(seed)
        blocks = leaf_blocks("".join(h for h, _, _ in made))
        if [b.text for b in blocks] == [" ".join(t.split()) for _, t, _ in made]:
            out.append((page_features(blocks), [int(y) for _, _, y in made]))
    return out


def main_text(source: str, model: Model) -> str:
    blocks = leaf_blocks(source)
    labels = model.viterbi(model.scores(page_features(blocks)))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


_trained: list[Model] = []


def trained_model() -> Model:
    if not _trained:
        _trained.append(fit(labelled_pages(PAGES)))
    return _trained[0]


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. One pass, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(trained_model())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html"):
            texts = [main_text(h, shared.value) for h in texts_of(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
