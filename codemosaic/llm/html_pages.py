"""Labelled pages to train the block labeller on: made by rule from a seed, in many layouts.

Each page is a list of blocks in page order, (html, text, is main text); joining the html gives the page. Words are drawn
letter by letter, so nothing but tags, classes and the shape of texts can be learned.
"""

from __future__ import annotations

import random

_VOWELS, _CONSONANTS = "aeiouéüó", "bcdfghklmnprstvwz"
_MAIN = (("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry"), ("div", "article-text"), ("div", "story"))
_ASIDE = (("aside", ""), ("div", "sidebar"), ("div", "related"), ("section", "widget"))
_ADS = (("div", "ad"), ("div", "ads banner"), ("aside", "sponsored"), ("div", "promo"), ("div", "advert"))
_NOTICES = (("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("section", "consent"), ("div", "newsletter"))
_COMMENTS = (("section", "comments"), ("div", "comment-list"), ("div", "replies"), ("ol", "comments"), ("div", "responses"), ("div", "discussion"), ("div", "user-comments"))
_SAYINGS = ("Comments", "# comments", "Comments (#)", "# replies", "Responses", "Discussion", "Leave a comment", "Kommentare", "# Antworten", "Commentaires", "Comentarios")
#: Names of wrappers and headings of articles that hold words of the others, so that these alone do not teach.
_WRAPPERS = ("comment-open", "has-comments", "responsive-layout", "img-responsive", "with-sidebar", "no-ads", "header-fixed", "page", "wrapper", "layout-wide", "menu-left", "single", "no-footer", "replies-closed")
_TITLES = ("Discussion", "Response times", "Corporate responsibility", "Comments on the method", "Discussion of results", "Replies by region", "Responses to drought", "Feedback loops", "Conclusion", "Reaction times")
_HEADERS = (("header", ""), ("div", "header"), ("div", "masthead"), ("div", "topbar"))
_FOOTERS = (("footer", ""), ("div", "footer"), ("div", "copyright"))
_MENUS = (("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "breadcrumb"), ("div", "pagination"))


def _word(r: random.Random) -> str:
    return "".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, least: int, most: int) -> str:
    words = [_word(r) + ("," if r.random() < 0.08 else r.choice(("***", "%%%", "&&&")) if r.random() < 0.03 else "") for _ in range(r.randint(least, most))]
    return " ".join(words).capitalize() + r.choice(("", ".", ".", ".", "!"))


def _text(r: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(r, 1, 25) for _ in range(r.randint(1, most)))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _open(tag: str, name: str) -> str:
    return f'<{tag} class="{name}">' if name else f"<{tag}>"


def _boilerplate(r: random.Random, kinds: tuple) -> list[tuple[str, str, bool]]:
    tag, name = r.choice(kinds)
    blocks = []
    for _ in range(r.randint(1, 4)):
        text = _sentence(r, 1, 12) if r.random() < 0.7 else _text(r, 3)
        inner = r.choice(("p", "li", "div", "span", "h3"))
        if kinds is _MENUS or r.random() < 0.2:
            inner, body = "li", f'<a href="/{_word(r)}">{_escaped(text)}</a>'
        else:
            body = _escaped(text)
        blocks.append((f"<{inner}>{body}</{inner}>", text, False))
    if r.random() < 0.3:  # all as one block, straight in the container
        text = r.choice(("&copy; ", "")) + _escaped(_sentence(r, 2, 14))
        blocks = [(text, text.replace("&copy;", "©").replace("&amp;", "&").replace("&lt;", "<"), False)]
    if kinds is _NOTICES and r.random() < 0.4:
        blocks.append(('<form><input type="text"><button>Ok</button></form>', "Ok", False))
    first, last = blocks[0], blocks[-1]
    blocks[0] = (_open(tag, name) + first[0], first[1], False)
    last = blocks[-1]
    blocks[-1] = (last[0] + f"</{tag}>", last[1], False)
    return blocks


def _article(r: random.Random) -> list[tuple[str, str, bool]]:
    tag, name = r.choice(_MAIN)
    blocks: list[tuple[str, str, bool]] = []
    title = _sentence(r, 1, 10)
    blocks.append((f"<h1>{_escaped(title)}</h1>", title, True))
    for _ in range(r.randint(1, 14)):
        kind, text = r.random(), _text(r)
        if kind < 0.1:
            text = r.choice(_TITLES) if r.random() < 0.35 else _sentence(r, 1, 6)
            blocks.append((f"<h2>{_escaped(text)}</h2>", text, True))
        elif kind < 0.2:
            for _ in range(r.randint(2, 4)):
                text = _sentence(r, 2, 12)
                blocks.append((f"<li>{_escaped(text)}</li>", text, True))
        elif kind < 0.3:
            blocks.append((f"<blockquote>{_escaped(text)}</blockquote>", text, True))
        elif kind < 0.4:  # unclosed tags
            blocks.append((f"<p><b>{_escaped(text)}<br>", text, True))
        elif kind < 0.47:
            blocks.append((f"<p>{_escaped(text)}", text, True))
        elif kind < 0.55:
            a = _sentence(r, 1, 3)
            blocks.append((f'<p>{_escaped(text)} <a href="#">{_escaped(a)}</a></p>', f"{text} {a}", True))
        elif kind < 0.6:
            blocks += [(h, t, False) for h, t, _ in _boilerplate(r, _ADS)]
        else:
            blocks.append((f"<p>{_escaped(text)}</p>", text, True))
    if len(blocks) > 3 and r.random() < 0.4:  # a part of the text in a container of any name
        i = r.randint(1, len(blocks) - 2)
        j = r.randint(i, len(blocks) - 1)
        if all(not h.startswith("<li") for h, _, _ in blocks[i : j + 1]):
            inner = r.choice(("div", "section"))
            blocks[i] = (_open(inner, r.choice(("", _word(r), f"{_word(r)}-{_word(r)}"))) + blocks[i][0], *blocks[i][1:])
            blocks[j] = (blocks[j][0] + f"</{inner}>", *blocks[j][1:])
    if r.random() < 0.4:
        blocks += _discussion(r, tag)
    blocks[0] = (_open(tag, name) + blocks[0][0], *blocks[0][1:])
    blocks[-1] = (blocks[-1][0] + f"</{tag}>", *blocks[-1][1:])
    return blocks


def _discussion(r: random.Random, main: str) -> list[tuple[str, str, bool]]:
    """What readers said, inside the main container: under a name or a heading that says so, or as articles of their own."""
    tag, name = r.choice(_COMMENTS)
    sign = r.random()
    if main != "article" and 0.3 <= sign < 0.5:
        sign = 0.5
    if sign < 0.5:  # no name that is known
        tag, name = r.choice(("div", "section", "aside")), r.choice(("", _word(r), f"{_word(r)}-{_word(r)}"))
    blocks: list[tuple[str, str, bool]] = []
    if sign < 0.3 or r.random() < 0.3:
        level = r.choice("2345")
        text = r.choice(_SAYINGS).replace("#", str(r.randint(1, 99)))
        blocks.append((f"<h{level}>{text}</h{level}>", text, False))
    if sign < 0.3 and len(blocks) and blocks[-1][1] == "Discussion" or sign < 0.5 and r.random() < 0.5:
        # Containers of one kind, each with a line of its writer and often one to reply.
        inner = "article" if 0.3 <= sign < 0.5 else r.choice(("div", "li", "section"))
        for _ in range(r.randint(2, 5)):
            who, text = _word(r).capitalize(), _text(r, 3)
            own = [(f"<p>{who}</p>", who), (f"<p>{_escaped(text)}</p>", text)]
            if r.random() < 0.5:
                own.append(('<p><a href="#">Reply</a></p>', "Reply"))
            own[0] = (f"<{inner}>{own[0][0]}", own[0][1])
            own[-1] = (f"{own[-1][0]}</{inner}>", own[-1][1])
            blocks += [(h, t, False) for h, t in own]
        blocks[0] = (_open(tag, name) + blocks[0][0], *blocks[0][1:])
        blocks[-1] = (blocks[-1][0] + f"</{tag}>", *blocks[-1][1:])
        return blocks
    for _ in range(r.randint(1, 5)):
        text = _text(r, 3)
        inner = "article" if 0.3 <= sign < 0.5 else r.choice(("div", "p", "li"))
        body = f"<p>{_escaped(text)}</p>" if inner == "article" or inner != "p" and r.random() < 0.5 else _escaped(text)
        blocks.append((f"<{inner}>{body}</{inner}>", text, False))
    if 0.3 <= sign < 0.5 and r.random() < 0.5:  # straight in the article
        return blocks
    blocks[0] = (_open(tag, name) + blocks[0][0], *blocks[0][1:])
    blocks[-1] = (blocks[-1][0] + f"</{tag}>", *blocks[-1][1:])
    return blocks


def page(seed: int) -> list[tuple[str, str, bool]]:
    """The blocks of one page."""
    r = random.Random(seed)
    title = _sentence(r, 1, 8)
    blocks = [(f"<!DOCTYPE html><html><head><title>{_escaped(title)}</title><style>p{{}}</style><script>var x='</p>';</script></head>", title, False)]
    wrapped = r.random() < 0.5
    names = [r.choice(_WRAPPERS) for _ in range(r.randint(0, 2))]
    blocks[0] = (blocks[0][0] + _open("body", " ".join(names) if r.random() < 0.4 else "") + (_open("div", r.choice(_WRAPPERS)) if wrapped else ""), *blocks[0][1:])
    for kinds, chance in ((_HEADERS, 0.5), (_MENUS, 0.9), (_NOTICES, 0.4), (_ADS, 0.5)):
        if r.random() < chance:
            blocks += _boilerplate(r, kinds)
    if r.random() < 0.3:
        blocks += _boilerplate(r, _ASIDE)
    blocks += _article(r)
    for kinds, chance in ((_COMMENTS, 0.45), (_ASIDE, 0.4), (_ADS, 0.3), (_MENUS, 0.2), (_FOOTERS, 0.9)):
        if r.random() < chance:
            blocks += _boilerplate(r, kinds)
    if wrapped:
        blocks[-1] = (blocks[-1][0] + "</div>", *blocks[-1][1:])
    if r.random() < 0.9:
        blocks[-1] = (blocks[-1][0] + "</body></html>", *blocks[-1][1:])
    return blocks
