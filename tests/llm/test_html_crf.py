import itertools
import random
import time

import numpy as np
import pytest

from codemosaic.llm import html_crf, html_pages


@pytest.fixture(scope="module")
def model():
    return html_crf.trained_model()


def test_held_out_pages(model):
    pages = html_crf.labelled_pages(150, first_seed=50_000)
    pairs = [(a, b) for rows, y in pages for a, b in zip(model.viterbi(model.scores(rows)), y, strict=True)]
    assert len(pages) > 120 and np.mean([a == b for a, b in pairs]) > 0.985


def test_viterbi_equals_enumeration(model):
    r = random.Random(3)
    for _ in range(60):
        scores = [r.uniform(-3, 3) for _ in range(r.randint(1, 8))]
        value = lambda y: sum(s for s, l in zip(scores, y, strict=True) if l) + sum(model.links[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert abs(value(model.viterbi(scores)) - max(map(value, itertools.product((0, 1), repeat=len(scores))))) < 1e-9


def test_article_comes_out_exactly(model):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>no</p> -->"
        '<div class="ad">Buy this now.</div><article><h1>Some &amp; title</h1><p><b>First   words\n here.<br><p>Second &lt;block&gt; with <i>inline</i>&nbsp;text.</p><p></p></article>'
        '<div class="comments"><p>I liked it.</p></div><footer>&copy; site &middot; all.</footer></body></html>'
    )
    assert html_crf.main_text(page, model) == "Some & title\nFirst words here.\nSecond <block> with inline text."


def test_blocks_of_broken_pages():
    texts = lambda s: [b.text for b in html_crf.leaf_blocks(s)]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("a<p>b<p>c</div>d<li>e") == ["a", "b", "c", "d", "e"]
    assert texts("<script>x") == [] and texts("<p>1 < 2 &am &amp</p>") == ["1 < 2 &am &"] and texts("<!-- open <p>x") == []
    assert texts('<p title="a>b">c</p>') == ["c"] and texts("<p>x</p" + ">" + "<br>y") == ["x", "y"]


def test_svg_hides_only_its_own_contents():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts('<p>one <svg class="i"/> two</p><p>three <svg><text>x</text></svg> four</p>') == ["one two", "three four"]
    assert texts("<p>one</p><svg><p>two</p>") == ["one", "two"]


def test_quotes_and_references_of_broken_pages():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p class=a'b>Kept text.</p>") == ["Kept text."] and texts("<p class=\"a>Kept</p><p class='b'>too") == ["Kept", "too"]
    assert texts("&am<b>p;</b> &amp;lt; &#60;p>") == ["&amp; &lt; <p>"] and texts("<p =x a = 'b>c' d/>y") == ["y"]
    for page in ('<p class="x>word ', "<p a='", "<svg><b>", "</x><i><p><b></i>", "<!", "<p a=b'c "):
        times = []
        for n in (4000, 16000):
            start = time.perf_counter()
            html_crf.leaf_blocks(page * n)
            times.append(time.perf_counter() - start)
        assert times[1] < 10 * times[0] + 0.2, page


def test_comments_inside_the_main_container(model):
    text = "<h1>A title</h1><p>This is the first paragraph of the article, and it is long.</p><p>This is the second one, which ends here.</p>"
    want = "A title\nThis is the first paragraph of the article, and it is long.\nThis is the second one, which ends here."
    said = "<p>I liked this very much, thank you.</p><p>So did I, and more.</p>"
    for main in ("main", "article"):
        for inside in (f'<section class="comments">{said}</section>', f'<div id="user_comment_area">{said}</div>', f'<div class="xyzzy"><h3>3 replies</h3>{said}</div>', f'<div class="postDiscussion"><ul><li>{said}</li></ul></div>'):
            assert html_crf.main_text(f"<body><{main}>{text}{inside}</{main}><footer>&copy; x</footer></body>", model) == want, inside
    own = "<section class='part'><h2>A part</h2><p>With text of its own, which is of the article.</p></section>"
    assert html_crf.main_text(f"<body><main>{text}{own}</main></body>", model) == want + "\nA part\nWith text of its own, which is of the article."
    assert html_crf.main_text(f"<article>{text}<article><p>I liked this very much, thank you.</p></article></article>", model) == want


def test_gradient_is_that_of_the_likelihood():
    """One training step moves the weights as numeric differences of the log likelihood say."""
    pages = [(rows, y) for rows, y in html_crf.labelled_pages(60) if len(rows) < 12][:2]
    fitted = html_crf.fit(pages, rounds=40)
    names = sorted({f for rows, _ in pages for row in rows for f in row})

    def loss(weights, links):
        m, total, n = html_crf.Model(weights, links), 0.0, 0
        for rows, y in pages:
            scores = m.scores(rows)
            value = lambda l: sum(s for s, k in zip(scores, l, strict=True) if k) + sum(links[a, b] for a, b in zip(l, l[1:], strict=False))  # noqa: B023, E731
            total += value(y) - np.logaddexp.reduce([value(l) for l in itertools.product((0, 1), repeat=len(y))])
            n += len(y)
        return total / n - html_crf.PENALTY / 2 * (sum(w * w for w in weights.values()) + (links**2).sum())

    for f in names[:: max(1, len(names) // 8)]:
        sides = []
        for d in (1e-5, -1e-5):
            sides.append(loss(fitted.weights | {f: fitted.weights[f] + d}, fitted.links))
        assert abs((sides[0] - sides[1]) / 2e-5 - html_crf.gradient(pages, fitted)[0][f]) < 1e-6
    for at in np.ndindex(2, 2):
        step = np.zeros((2, 2))
        step[at] = 1e-5
        assert abs((loss(fitted.weights, fitted.links + step) - loss(fitted.weights, fitted.links - step)) / 2e-5 - html_crf.gradient(pages, fitted)[1][at]) < 1e-6


def test_made_pages_are_cut_as_they_were_made():
    assert len(html_crf.labelled_pages(100)) > 80 and html_pages.page(5) == html_pages.page(5)


def test_extract(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (2, None, "", "x", "y"), (None, "u", "<article><h1>T</h1><p>One sentence that is long enough.</p></article>", "x", "y"), (4, "u", "<article>" + "<p>Some long text of a page, with words.</p>" * 5000 + "</article>", "x", "y")]
    got = html_crf.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert next(r.text for r in got if r.page_id == 4).count("\n") == 4999
    assert html_crf.extract(spark.createDataFrame([], schema)).count() == 0


P = "<p>Some long paragraph of the article with many words in it, and more words.</p>"
SAID = P[3:-4]


@pytest.mark.parametrize("name", ["responsive-layout", "img-responsive", "layout-wide", "comment-open", "has-comments single", "with-replies", "no-sidebar"])
def test_names_of_the_layout_say_nothing(name):
    model = html_crf.trained_model()
    for page in (f"<html><body class='{name}'><article><h1>T</h1>{P}{P}</article></body></html>", f"<body><nav><a href=x>a</a></nav><div class='{name}'><main><h1>T</h1>{P}{P}</main></div><footer>c</footer>"):
        assert html_crf.main_text(page, model) == f"T\n{SAID}\n{SAID}"


@pytest.mark.parametrize("title", ["Corporate responsibility", "Corporate duty", "Discussion", "Response times", "Comments on the method"])
def test_honest_headings_keep_their_text(title):
    assert html_crf.main_text(f"<body><article><h1>T</h1>{P}<h2>{title}</h2>{P}</article>", html_crf.trained_model()) == f"T\n{SAID}\n{title}\n{SAID}"


@pytest.mark.parametrize(
    "said",
    [
        "<section class='comments'><h2>2 Comments</h2><div class=c><p>Ann</p><p>I liked it a lot.</p></div><div class=c><p>Bob</p><p>Me too.</p></div></section>", "<div><h2>Comments</h2><p>I liked it a lot.</p><p>Me too.</p></div>",
        "<div class='comment-list'><p>I liked it a lot.</p></div>", "<section><article><p>I liked it a lot.</p></article><article><p>Me too.</p></article></section>",
    ],
)
def test_comments_within_the_article_go(said):
    assert html_crf.main_text(f"<body><article><h1>T</h1>{P}{said}</article><footer>&copy; c</footer>", html_crf.trained_model()) == f"T\n{SAID}"


def test_held_out_pages_with_misleading_names():
    model, right, n = html_crf.trained_model(), 0, 0
    for rows, gold in html_crf.labelled_pages(300, 5000):
        right += sum(a == b for a, b in zip(model.viterbi(model.scores(rows)), gold, strict=True))
        n += len(gold)
    assert right / n >= 0.99


def test_deep_pages_take_linear_time():
    deep = "".join(f"<div class='n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>t{i}" for i in range(8000))
    began = time.perf_counter()
    html_crf.main_text(deep, html_crf.trained_model())
    assert time.perf_counter() - began < 10
