"""Operator 3 on pages written by hand, none of them from its own page builder."""

import random

import pytest

from vintage.llm import html_crf


def texts(page):
    return [b.text for b in html_crf.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><body><article><p>Hello", ["Hello"]),  # no </head>
        ("<html><head><title>T</title><meta name=x><p>One<p>Two", ["One", "Two"]),  # no <body> either
        ("<head><title>T</title>One", ["One"]),
        ('<p>a <svg class="i"/> b</p><p>c</p>', ["a b", "c"]),
        ("<p>a<math/>b</p><svg viewBox='0 0 1 1' /><p>c</p>", ["ab", "c"]),
        ("<p>a<svg><g><svg><text>no</text></svg><title>t</title></g></svg>b</p><p>c</p>", ["ab", "c"]),  # nested
        ("<div><svg><path d=1></div><p>c</p><p>x<svg></svg></p>", ["c", "x"]),  # unclosed
        ("<p>a<svg><foreignObject><p>no</p></foreignObject></svg>b", ["ab"]),
        ("<p>a<svg-icon></svg-icon>b</p><video-js></video-js><p>c</p>", ["ab", "c"]),  # custom elements
        ("<div><select><option>x<option>y</div><p>c</p>", ["x", "y", "c"]),  # never closed: an element like any other
        ("<p>a<select><option>x</option></select>b</p><p>c", ["ab", "c"]),
        ("<p>a<video src=x><p>b</p><video>no</video><textarea>c<p>d", ["a", "b", "c", "d"]),
        ("<p>a<textarea><p>no</textarea>b<iframe>no</iframe><noscript><p>no</p></noscript>", ["ab"]),
        ("<p>a <object><p>no</p></object> b</p>", ["a b"]),
        ("<template><p>no</p></template><p>yes", ["yes"]),
        ("<p>a<!-- x > <p>no</p> -->b<!-->c", ["abc"]),
        ("<p>a<script>if (x < y) '</p>'</script >b<STYLE>p{}</STYLE>", ["ab"]),
        ('<p title="a>b">c</p><p title="odd>d', ["c", "d"]),
        ("</div></p>a</article><p>b</p></p>", ["a", "b"]),
        ("<article><p>a<article><p>b</p></article>c", ["a", "b", "c"]),
        ("no tags at all &amp; &#8364; &lt;p&gt;", ["no tags at all & € <p>"]),
        ("", []),
        (None, []),
    ],
)
def test_no_text_is_lost_or_invented(page, want):
    assert texts(page) == want


def test_long_and_deep_pages_take_one_pass():
    assert len(texts("<p>word</p>" * 50_000)) == 50_000
    assert len(texts("<div>x" * 20_000)) == 20_000
    assert texts("<select>" * 20_000 + "<p>x") == ["x"]
    assert texts("<svg>" * 5_000 + "<p>x") == ["x"]
    assert len(texts("<" * 50_000)[0]) == 50_000


LONG = "The committee met for the third time this year and, after a long debate, agreed on most of the points. Some members asked for more time."
LATER = "A second paragraph goes on with the matter: it names the people involved, gives dates, and ends with a full stop."
#: (html, blocks of the article), labelled by hand.
PAGES = [
    (f"<html><body><nav><a href=/>Home</a> <a href=/a>About us</a></nav><main><h1>The meeting</h1><p>{LONG}</p><p>{LATER}</p></main><footer>© 2020 Town paper</footer></body></html>", ["The meeting", LONG, LATER]),
    (f"<body><div id=header><a href=/>Town paper</a></div><div id=content><h1>The meeting</h1><p>{LONG}</p><ul><li>First point, agreed.</li><li>Second point, put off until spring.</li></ul><p>{LATER}</p></div><div id=footer>© 2020</div>", ["The meeting", LONG, "First point, agreed.", "Second point, put off until spring.", LATER]),
    (f"<div class='site-nav menu'><ul><li><a href=1>News</a><li><a href=2>Sport</a><li><a href=3>Weather</a></ul></div><article><h2>Notes</h2><p>{LONG}</p><aside><p>Buy our almanac today.</p></aside><p>{LATER}</p><section id=comments><p>I was there, it was dull.</p></section></article>", ["Notes", LONG, LATER]),
    (f"<div><ul><li><a href=1>News</a><li><a href=2>Sport</a><li><a href=3>Weather</a><li><a href=4>Jobs</a></ul></div><div><h1>Plain markup</h1><p>{LONG}</p><p>{LATER}</p><p>{LONG}</p><p>{LATER}</p></div><div>© Nobody</div>", ["Plain markup", LONG, LATER, LONG, LATER]),
    (f"<html><head><title>x</title><body><div class=cookie-banner><p>We use cookies to keep you signed in.</p><button>Accept</button></div><div class=story><p>{LONG}<p>{LATER}<blockquote>We shall see, said the mayor to the press.</blockquote><p>{LONG}</div><form><label>Mail</label><input></form>", [LONG, LATER, "We shall see, said the mayor to the press.", LONG]),
    (f"<body><header><h1><a href=/>Gazette</a></h1></header><main><article><header><h1>A title inside</h1></header><p>{LONG}</p><figure><svg/><figcaption>The hall.</figcaption></figure><p>{LATER}</p></article></main>", ["A title inside", LONG, "The hall.", LATER]),
]


def test_hand_labelled_pages():
    sentences = ["One plain sentence stands here.", "Another follows it, with a comma.", "So does a third one that is rather longer than both of them.", "News", "Short words."]
    rng = random.Random(5)
    field = html_crf.train([html_crf.build_page(rng, sentences).replace(html_crf._MARK, "") for _ in range(40)])
    hit = gone = extra = 0
    for page, want in PAGES:
        own = html_crf.blocks(page)
        got = [b.text for b, y in zip(own, field.decode(html_crf.features(own))) if y]
        hit, gone, extra = hit + sum(w in got for w in want), gone + sum(w not in got for w in want), extra + sum(g not in want for g in got)
        assert LONG in got  # the body of every article
    assert hit / (hit + gone) >= 0.9 and hit / (hit + extra) >= 0.9


def test_edges_of_the_table(spark):
    kind = "page_id long, url string, html string, text string, n_chars string, extra int"
    assert html_crf.extract(spark.createDataFrame([], kind), html_crf.train([], 5)).collect() == []
    assert html_crf.fit(spark.createDataFrame([], kind), built_pages=3).emit
    rows = [(None, None, PAGES[0][0], "old", "old", 1), (1, "u", PAGES[0][0], None, None, 2), (1, "u", PAGES[0][0], None, None, 2), (2, "u", None, None, None, None), (3, "u", "word " * 200_000, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = html_crf.extract(df, html_crf.train([PAGES[0][0]], 50)).orderBy("page_id").collect()
    assert got[0].asDict().keys() == {"page_id", "url", "extra", "text", "n_chars"}
    assert [r.page_id for r in got] == [None, 1, 1, 2, 3] and got[1] == got[2] and got[3].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
