from __future__ import annotations

import html
import random
import re

import pytest
from tidemark.llm import maintext
from tidemark.llm.maintext import main_text

SF = "/root/testdata/sf0.001"

NOISE = {
    "menu": '<nav><ul><li><a href="/a">Start</a></li><li><a href="/b">All news</a></li></ul></nav>',
    "menu by class": '<div class="main-menu"><a href="/a">Start</a> <a href="/b">News</a></div>',
    "link list": "<ul><li><a href='/1'>One</a><li><a href='/2'>Two</a><li><a href='/3'>Three</a></ul>",
    "header": "<header><h1>The Daily Page</h1><p>Everything, every day.</p></header>",
    "footer": "<footer><p>Copyright, all rights reserved. Made with care, by us.</p></footer>",
    "sidebar": '<aside><p>Also read this, and that. You will like it, surely.</p></aside>',
    "sidebar by id": '<div id="left-sidebar"><p>Also read this, and that. Yes, all.</p></div>',
    "notice": '<div class="cookie-notice"><p>We use cookies, many of them. Accept?</p></div>',
    "advert": '<div class="ad"><p>Buy now, pay later. Only today, only here.</p></div>',
    "form": "<form action='/s'><label>Your mail, please.</label><input name=q></form>",
    "script": "<script>if (a < b) { document.write('<p>No, no. No.</p>') }</script>",
    "style": "<style>p > a { color: red }</style>",
    "comments": '<section id="comments"><h3>2 comments</h3><article class="comment"><p>I like it,'
    " a lot. Really, a lot of good thoughts, well said, by someone.</p></article></section>",
    "comment mark": "<!-- <p>hidden, of course.</p> -->",
}


def page(rng, wrap):
    """A page of random sentences and noise with the text that should come out."""
    say = lambda n: " ".join(
        "".join(rng.choices("abcdefg", k=rng.randint(2, 8))) + rng.choice(["", "", ",", "."])
        for _ in range(n)
    )
    want, inner = [], []
    for tag in ["h1", *rng.choices(["p", "p", "p", "h2", "blockquote", "pre"], k=rng.randint(3, 8))]:
        text = say(rng.randint(2, 60) if tag not in ("h1", "h2") else 4)
        want.append(text)
        words = text.split(" ")
        words[0] = f"<b>{words[0]}</b>"
        words[-1] = f'<a href="/x?a=1&amp;b=2">{words[-1]}</a>'
        inner.append(f"<{tag}>\n  " + rng.choice(["<br>", " \n", "&nbsp;", " "]).join(words) + f" </{tag}>")
    want.append("x & y")
    inner.append("<ul><li>x &amp;\ty</ul>")
    noise = rng.sample(sorted(NOISE), k=rng.randint(2, len(NOISE)))
    before = [NOISE[k] for k in noise if k != "comments"]
    after = [NOISE[k] for k in noise if k == "comments"] + [NOISE["footer"]]
    body = "".join(before) + wrap.format("".join(inner)) + "".join(after)
    return f"<!DOCTYPE html><html><head><title>T, t. T.</title></head><body>{body}</body></html>", " ".join(want)


@pytest.mark.parametrize(
    "wrap",
    [
        "<article>{}</article>",
        "<main><div><div>{}</div></div></main>",
        '<div class="content">{}</div>',
        '<div id="c17"><div>{}</div></div>',
        "<table><tr><td>{}</td></tr></table>",
    ],
)
def test_article_comes_out_of_noise(wrap):
    rng = random.Random(wrap)
    for _ in range(40):
        source, want = page(rng, wrap)
        assert main_text(source) == want


def test_the_tables_pages_come_out_whole(small):
    rows = small("pages").collect()
    for row in rows:
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert main_text(row.html) == " ".join(p for p in parts if p)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a < b and b > c", "a < b and b > c"),
        ("<<<<p>x", "<<< x"),
        ("<nav>menu</nav>", ""),
        ("<p title='a>b'>t</p>", "t"),
        ("<p>one<p>two<li>three", "one two three"),
        ("<p>no<em>space</em>here<br>but here", "nospacehere but here"),
        ("<p>&lt;b&gt; &amp;amp; &#x41; &am &copy", "<b> &amp; A &am ©"),
        ("<p hidden>gone<p>stays", "stays"),
        ("<form id=all><div><article><p>In a form, all.</p></article></div></form>", "In a form, all."),
        ("<p>open <b>tags <i>never", "open tags never"),
        ("<p>x</p><script>never ends", "x"),
        ("<p>x</p><!-- never ends", "x"),
        ("<article><p>A.</p><p>B</p></article><article class='comment'><p>C, c. C.</p></article>", "A. B"),
    ],
)
def test_odd_pages(source, want):
    assert main_text(source) == want


def test_long_and_deep_pages_take_linear_time():
    words = "word, " * 400_000
    assert main_text(f"<article><p>{words}</article>") == words.strip()
    assert main_text("<div>" * 50_000 + "deep.") == "deep."
    many = "".join(f"<div><p>Text {i}, yes.</p></div>" for i in range(20_000))
    assert main_text(many).endswith("Text 19999, yes.")
    for opener in ("<a ", "<a href='", '<a href="x" ', "<!--", "<script>", "<p>x<b>"):
        main_text(opener * 20_000)


def test_smoothing_is_over_siblings_and_parent():
    assert maintext.smoothed([4.0, 2.0, 0.0], [-1, 0, 0], [True, True, True]) == [
        pytest.approx((4 + 2.0) / 1.75),
        pytest.approx((2 + 0.5 * 1 + 1) / 1.75),
        pytest.approx((0 + 0.5 * 1 + 1) / 1.75),
    ]


def test_rows_and_columns(spark):
    rows = [(1, "u", "<p>é x</p>", 9), (None, None, None, None), (1, "u", "<p>é x</p>", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, out int")
    got = maintext.extract(pages)
    assert got.columns == ["row", "out"] and got.schema["row"].dataType.names == pages.columns
    assert sorted((r.row.page_id or 0, r.out) for r in got.collect()) == [(0, ""), (1, "é x"), (1, "é x")]
    assert maintext.extract(pages.limit(0)).count() == 0


def test_op13(spark):
    got = maintext.op13(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 for r in rows)
