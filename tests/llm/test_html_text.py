"""Main text of pages: planted articles in several layouts, votes of hosts, broken markup."""

import html
import random
import re
import time

import pytest

from sonarframe.llm import html_text as H

WORDS = "the of naïve & <b> quick \"fox\" jumps over lazy dog's été 日本 42 a;b &amp; 1 < 2 nbsp x > y".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def spaced(draw, text):
    """Escaped, with white space of other kinds in place of spaces."""
    return "".join(draw.choice([" ", " ", "\n\t ", "&nbsp;", "<br>", " <!-- x --> "]) if c == " " else html.escape(c) if draw.random() < 0.9 else f"&#{ord(c)};" for c in text)


def layout(kind, draw, blocks):
    title, *rest = blocks
    p = lambda t: f"<p>{spaced(draw, t)}</p>"
    noise = lambda n=8: spaced(draw, sentence(draw, n))
    comments = "".join(f'<article class="comment"><p>{noise(90)}</p></article>' for _ in range(3)) if kind % 2 else "".join(f'<li class="comment-{i}"><p>{noise(60)}</p></li>' for i in range(4))
    around = (
        f'<html><head><title>{noise()}</title><style>p > a{{}}</style><script>if (a < b) x = "<p>no</p>";</script></head><body><header class="site-header"><h1>{noise()}</h1></header>'
        f'<nav><ul><li><a href="/">{noise()}</a></li></ul></nav><div class="cookie-notice">{noise(30)}</div><!-- <p>gone</p> -->',
        f'<aside><p>{noise(40)}</p></aside><div id="sidebar"><p>{noise(50)}</p></div><section id="comments" class="comments-area">{comments}</section><form action="/x"><p>{noise(20)}</p><input></form>'
        f'<div class="ad-slot">{noise(20)}</div><div hidden><p>{noise(30)}</p></div><footer><p>{noise(30)}</p></footer></body></html>',
    )
    body = {
        0: f"<article><h1>{spaced(draw, title)}</h1>{''.join(map(p, rest))}</article>",
        1: f'<div class="wrap"><div class="post post-{draw.randrange(99)} category-social"><h2>{spaced(draw, title)}</h2><div class="entry">{"".join(map(p, rest))}</div></div></div>',
        2: f'<main><article><header><h1>{spaced(draw, title)}</h1><p class="byline">{noise(3)}</p></header><section>{"".join(map(p, rest[:2]))}</section><section><ul>{"".join(f"<li>{spaced(draw, t)}" for t in rest[2:])}</ul></section><footer>{noise()}</footer></article></main>',
        3: f"<form id=all><div id=main-content><h1>{spaced(draw, title)}{''.join(f'<p>{spaced(draw, t)}' for t in rest)}</div></form>",
        4: f'<table><tr><td class="left"><a href="/a">{noise()}</a><td class="c7"><h1>{spaced(draw, title)}</h1>{"".join(map(p, rest))}</table>',
    }[kind]
    return around[0] + body + around[1]


def page(kind, draw):
    blocks = [sentence(draw, draw.randrange(3, 8)), *(sentence(draw, draw.randrange(12, 60)) for _ in range(draw.randrange(3, 9)))]
    return layout(kind, draw, blocks), "\n\n".join(blocks)


@pytest.mark.parametrize("most_paths", [1 << 14, 0])
def test_planted_articles(spark, most_paths):
    draw = random.Random(6)
    rows, want = [], {}
    for i in range(150):
        kind = i % 5
        source, text = page(kind, draw)
        rows.append((i, f"https://site{kind}.example/{i}?x", source, "clash", "clash"))
        want[i] = text
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string"), most_paths=most_paths).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id


def test_a_hosts_votes_decide_its_pages(spark):
    draw = random.Random(2)
    rows = []
    for i in range(20):
        article, other = [sentence(draw, 30) for _ in range(6)], [sentence(draw, 8)]
        if i == 19:  # an article that is shorter than what stands beside it
            article, other = [sentence(draw, 4)], [sentence(draw, 80) for _ in range(3)]
        rows.append((i, "http://h.example/", f"<body><div class=x{i}>" + "".join(f"<p>{html.escape(t)}</p>" for t in article) + "</div><div class=y>" + "".join(f"<p>{html.escape(t)}</p>" for t in other) + "</div>", "\n\n".join(article)))
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.main_text(frame).collect()}
    assert got == {r[0]: r[3] for r in rows}
    alone = H.main_text(frame.where("page_id = 19")).first().text  # without its host it would be taken for the other container
    assert alone != rows[19][3]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = H.main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id])[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|b)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://a/", "<p>"), (3, "no host", "just text & no &amp; tags"), (4, "http://b/", "<nav>only a menu</nav>"), (5, "http://c/", "<!-- unclosed <p>x</p>"), (6, "http://d/", "<p>a</p><script>unclosed <p>b</p>")]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "", 0), (2, "", 0), (3, "just text & no & tags", 21), (4, "", 0), (5, "", 0), (6, "a", 1)], key=str)
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("source", ["<div class=a>x" * 20000, "<p>x" * 60000, "</div>" * 60000, "<a b='" * 60000, "<b" * 60000, "<!-" * 60000, "<script>" + "</scrip" * 60000, "<table><tr><td>x" * 20000, "<li>x" * 60000, "<" * 200000, "<span class=ad>x" * 20000, "<p>" + "word " * 400000, "<i>x" * 60000, "&#" * 100000])
def test_broken_and_long_pages_take_linear_time(source):
    began = time.process_time()
    H.extract(source, ["/html/body/article", "/p"])
    assert time.process_time() - began < 8


def test_paths_leave_out_numbers_and_stay_short():
    element = H._entered(H._Page("").root, "div", {"class": "post-12 b a7"}, frozenset())
    assert element.path == "/div.a#.b.post-#"
    for _ in range(100):
        element = H._entered(element, "div", {"class": "x" * 90}, frozenset())
    assert len(element.path) <= 801
