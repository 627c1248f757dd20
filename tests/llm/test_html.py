"""Main text of pages whose text is known, and odd or hostile pages."""

import html
import random
import time

import pytest

from quillon.llm import html_text, queries

WORDS = "river stone quiet market seven lantern & garden < window copper éclair morning, number over under".split(" ")


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).strip() + "."


def marked_up(rnd, text):
    """The text with references, odd white space, inline elements and comments that don't change it."""
    out = []
    for w in text.split(" "):
        w = html.escape(w, quote=False) if rnd.random() < 0.8 else "".join(f"&#{ord(c)};" for c in w)
        out.append(rnd.choice(["{}", "<b>{}</b>", "<i class='x'>{}</i>", "{}", "{}", "<span>{}</span>", "{}<!-- no <p> here -->"]).format(w))
    return rnd.choice([" ", "\n  ", " \t "]).join(out)


def clutter(rnd):
    links = "".join(f"<li><a href='/{i}'>Link number {i}, and more</a></li>" for i in range(rnd.randint(3, 9)))
    return rnd.choice([
        f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'><h3>Related</h3><ul>{links}</ul></div>", f"<div id='cookie-notice'><p>{sentence(rnd, 20)}</p></div>", f"<aside><p>{sentence(rnd, 30)}</p></aside>",
        f"<footer><p>{sentence(rnd, 15)}</p></footer>", f"<div class=\"ad-banner ads\"><p>{sentence(rnd, 25)}</p></div>", f"<section class='comments'><p>{sentence(rnd, 40)}</p><p>{sentence(rnd, 40)}</p></section>",
        f"<form action='/x'><p>{sentence(rnd, 12)}</p><input name='q'><button>Go</button></form>", "<script>var a = '<p>no text</p>';</script>", "<style>p { color: red }</style>", f"<header><h1>Site</h1><p>{sentence(rnd, 9)}</p></header>", "<noscript><p>Turn it on.</p></noscript>",
    ])


def page(seed):
    rnd = random.Random(seed)
    blocks, body = [], []
    for k in range(rnd.randint(2, 14)):
        text = sentence(rnd, rnd.randint(12, 60)) if k else sentence(rnd, 6)
        tag = "h1" if not k else rnd.choice(["p", "p", "p", "h2", "blockquote", "pre"])
        blocks.append(text)
        body.append(f"<{tag}>{marked_up(rnd, text)}</{tag}>" if tag != "p" or rnd.random() < 0.6 else f"<p>{marked_up(rnd, text)}\n")  # an end tag may be missing
        if rnd.random() < 0.2:
            body.append(rnd.choice(["<script>if (1 < 2) {}</script>", "<div class='share'><a href='#'>Share</a></div>", "<aside><p>See also, this.</p></aside>"]))
        if rnd.random() < 0.2:
            items = [sentence(rnd, 8) for _ in range(3)]
            blocks += items
            body.append("<ul>" + "".join(f"<li>{marked_up(rnd, i)}" for i in items) + "</ul>")
    before, after = ("".join(clutter(rnd) for _ in range(rnd.randint(1, 4))) for _ in range(2))
    inner = "\n".join(body)
    inner = rnd.choice(["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div class='content'>{}</div>", "<div id=main-text>{}</div>"]).format(inner)
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{inner}{after}</body></html>", "\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("seed", range(120))
def test_the_article_and_nothing_else(seed):
    given, want = page(seed)
    assert html_text.main_text(given) == want


@pytest.mark.parametrize("text,want", [
    (None, ""), ("", ""), ("just words &amp; more", "just words & more"), ("<p>one<p>two", "one\ntwo"), ("<p>a<br>b", "a b"), ("<p>a</i></b>b</div>", "ab"), ("<p>x &#99999999999; &#x41;&#0000000066; &nosuch;", "x � AB &nosuch;"),
    ("<p>open <a href=\"x>quote</p><p>next</p>", "open quote\nnext"), ("<p>less < more > less", "less < more > less"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<script>only", ""), ("<!-- only", ""), ("<p>cut <b", "cut <b"),
])
def test_odd_pages(text, want):
    assert html_text.main_text(text) == want


@pytest.mark.parametrize("given", [
    "<blockquote>a, b " * 60_000, '<a "' * 250_000, "<p class='" * 100_000, "<div>" * 60_000 + "</b>" * 200_000, "<div>" * 60_000 + "<td>x</td>" * 60_000, "<b><li>x" * 60_000,
    "<" * 1_000_000, "&#" + "1" * 1_000_000 + ";", "<p " + "a" * 1_000_000 + ">x", "<meta " * 150_000, "<table><tr><td>" + "<div>" * 50_000 + "</i>" * 100_000,
], ids=lambda x: x[:12])
def test_a_megabyte_of_odd_markup_takes_seconds(given):
    start = time.process_time()
    html_text.main_text(given)
    assert time.process_time() - start < 20  # quadratic work would take many minutes


def test_rows(spark, tmp_path):
    long = "<article>" + "".join(f"<p>Paragraph {i}, with some words in it.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", page(1)[0], "t"), (3, "u", page(2)[0], "t"), (3, "u", page(2)[0], "t"), (4, "v", long, "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op6_html_tree_scoring"](spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    whole = "\n".join(f"Paragraph {i}, with some words in it." for i in range(20_000))
    want = [(1, "u", ""), (2, None, ""), (None, "u", page(1)[1]), (3, "u", page(2)[1]), (3, "u", page(2)[1]), (4, "v", whole)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((*w, len(w[2]))) for w in want)
