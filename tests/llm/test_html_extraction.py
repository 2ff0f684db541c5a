import html as entities
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm.html_extraction import article, common_lines, extract, parse


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, key string, host string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body class='has-sidebar'>{body}</body></html>"


def text(html):
    p = parse(html)
    return "\n\n".join(b.text for b, k in zip(p.blocks, article(p)[0], strict=True) if k)


def plain(html):
    """The article of a page of the supplied tables, by patterns."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)(?:>|$)", re.sub(r"<[a-z/0-9]*$", "", body))
    return "\n\n".join(b for b in (" ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in blocks) if b)


def test_supplied_pages_against_patterns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        assert r.text == want.pop(r.page_id) and r.n_chars == len(r.text)
    assert not want


@pytest.mark.parametrize(("html", "want"), [
    (page("<header><h1>Site</h1></header><nav>Menu</nav><article><header><h2>Title</h2><span>by me</span></header><p>One <b>bo</b>ld&nbsp;\n two<br>three<p>Two &lt;b&gt; &amp;amp; &copy<footer>tags</footer></article><aside>Side</aside><footer>Foot</footer>"), "Title\n\nOne bold two three\n\nTwo <b> &amp; ©"),
    (page("<div class='cookie-notice'>We use cookies.</div><main><p>Text.</p><form><label>Mail</label><input><button>Go</button></form><ul><li>a<li>b</ul><section id='comments'><h3>Comments</h3><article class='comment'>A very long reader comment, longer than the text.</article></section></main>"), "Text.\n\na\n\nb"),
    (page("<div id=wrap class='page has-sidebar'><div class='post-content'><p>Body</p><div class=ad>Buy</div><table><tr><td>x<td>y</table></div></div><div class='related-posts'><article>Teaser teaser teaser teaser teaser</article></div>"), "Body\n\nx\n\ny"),
    (page("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript><p title='<p>no'>yes</p><select><option>no</select>"), "yes"),
    ("<p>a<p>b <i>c", "a\n\nb c"),
    ("<p>cut off <a hre", "cut off"),
    ("<p>1 < 2 &am <script>never closed <p>x", "1 < 2 &am"),
    ("no markup &quot;at&quot; all", 'no markup "at" all'),
    ("<form action=x><div class=content><p>in a page-wide form</p></div></form>", "in a page-wide form"),
    ("<div role='navigation'>n</div><div itemprop='articleBody'>t<div role=alert>a</div></div><div>rest</div>", "t"),
    ("", ""), (None, ""), ("<nav>x</nav>", ""), ("<article></article><p>x", "x"),
])
def test_markup(html, want):
    assert text(html or "") == want


def test_shared_lines_of_neighbours_go(spark):
    def bare(i, host="a.example", lines=4):
        own = "".join(f"<p>Sentence {j} of page {i} of {host}.</p>" for j in range(lines))
        return f"https://{host}/n/{i:03}?x={i}#y", f"<div>Start</div><p>We like news.</p>{own}<div>Read on</div><p>Written in {host}</p>"

    def own(i, host="a.example", lines=4):
        return "\n\n".join(f"Sentence {j} of page {i} of {host}." for j in range(lines))

    many = [bare(i) for i in range(60)]
    marked = [(f"https://b.example/{i}", f"<article><div>Share it</div><h1>Day</h1><p>Same words.</p><p>Number {i} is told here, and {i} more of it in its own words.</p><ul><li>Mail</ul></article>") for i in range(5)]
    copies = [(f"https://c.example/{i}", f"<p>Top</p><p>{'One article that two addresses show. ' * 5}</p><i>{i}</i>") for i in range(2)]
    alone = [("https://d.example/1", "<div>Start</div><p>Alone.</p>"), (None, "<p>No address.</p>"), ("mailto:x", "<p>Other address.</p>"), (None, None)]
    rows = many + marked + copies + alone + many[:3]
    random.Random(3).shuffle(rows)
    got = extract(table(spark, rows).repartition(6))
    by = {}
    for r in got.collect():
        by.setdefault((r.url, rows[r.page_id][1]), []).append(r.text)
    assert sum(map(len, by.values())) == len(rows)
    for i, r in enumerate(many):
        assert by[r] == [own(i)] * (2 if i < 3 else 1)
    for i, r in enumerate(marked):  # ends have one neighbour only
        middle = f"Day\n\nSame words.\n\nNumber {i} is told here, and {i} more of it in its own words."
        assert by[r] == [middle if 0 < i < 4 else f"Share it\n\n{middle}\n\nMail"]
    for r in copies:
        assert by[r] == ["\n\n".join(["Top", ("One article that two addresses show. " * 5).strip(), r[1][-5]])]
    assert [by[r] for r in alone] == [["Start\n\nAlone."], ["No address."], ["Other address."], [""]]


def test_empty_table_and_one_page(spark):
    assert extract(table(spark, [])).collect() == []
    assert texts(extract(table(spark, [("http://x.example/", "<p>x")] * 3))) == {0: "x", 1: "x", 2: "x"}


def test_very_long_pages(spark):
    body = lambda i: "<div>top</div>" + "".join(f"<p>{j} {i if j % 5 else ''}</p>" for j in range(30_000)) + "<p>end</p>"
    got = texts(extract(table(spark, [(f"http://l.example/{i}", body(i)) for i in range(2)])))
    assert got == {i: "\n\n".join(f"{j} {i}" for j in range(30_000) if j % 5) for i in range(2)}


@pytest.mark.parametrize("bad", ["<a '" * 50_000, "<" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<td>" * 50_000, '<p a="' + "x<p>" * 50_000, "<!--" * 50_000, "<b>" * 50_000 + "<dd>" * 50_000, "<div>" * 50_000 + "<p>x" * 50_000, "<article class=post>" * 3000 + "x"])
def test_broken_markup_takes_linear_time(bad):
    import time

    began = time.process_time()
    text(bad)
    assert time.process_time() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_common_lines_are_longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    xs, ys = common_lines(a, b)
    assert len(xs) == size[-1][-1] and [a[i] for i in xs] == [b[j] for j in ys]
    assert xs == sorted(set(xs)) and ys == sorted(set(ys))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<li>", "<table>", "<td>", "</table>", "word", " ", "&lt;", "<", "<br>", "<!--", "-->", "<script>", "</script>", "'", '"', "<a href='", ">"]), max_size=25))
def test_any_markup_parses(parts):
    html = "".join(parts)
    p = parse(html)
    assert all(b.text == " ".join(b.text.split()) and b.text for b in p.blocks)
    assert len(article(p)[0]) == len(p.blocks)
