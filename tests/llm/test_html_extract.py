"""Page extraction: pages with known texts, template classes by brute force, defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from packwright.llm import html_extract as H

PAGES = [
    ("<html><body class='has-sidebar'><header><h1>Site</h1></header><div class='cookie-notice'>We use</div><main>"
     "<article class='post tag-ads'><header><h1>T &amp; x</h1></header><p>One<br>two <b>b</b>old&nbsp; x<p>Next<ul><li>a<li>b</ul>"
     "<div class='ad-slot'>buy</div><aside>s</aside><footer>by me</footer></article>"
     "<section id='comments'><article class='comment'>no</article></section></main><footer>f</footer>",
     "T & x\n\nOne two bold x\n\nNext\n\na\n\nb"),
    ("plain  text\nonly", "plain text only"),
    ("", ""), (None, ""), ("<p></p> <div>\n</div>", ""),
    ('<p>open <a href="x>quote <b>c</b></p><p>next', 'open <a href="x>quote c\n\nnext'),
    ('<div><p>x</p><script>var a="</p><p>no";</script><form>f<input>q</form>y</div>', "x\n\ny"),
    ("<article><p>a<table><tr><td>1<td>2<tr><td>3</table>z</article>tail", "a\n\n1\n\n2\n\n3\n\nz"),
    ("<textarea><p>no</textarea>yes<!-- c > --><![CDATA[x]]>!<style>p{}</style>", "yes!"),
    ("< 3 and <3 &lt;p&gt; &#233;&eacute;&amp", "< 3 and <3 <p> éé&"),
    ("<article><h1>H</h1><svg><title>x</title><p>n</p></svg><p>k<nav>n</nav></article>", "H\n\nk"),
    ("<div role='navigation'>n</div><p class='NewsletterBox'>n</p><p id=share-buttons>n</p><p class='adorable'>kept</p>", "kept"),
    ("<article><p>cut in the mid", "cut in the mid"), ("<body><p>a</p><p>b &am", "a\n\nb &am"),
    ("<ARTICLE><P>Upper</P></ARTICLE><P>out</P>", "Upper"),
    ("<script>never closed <p>x</p>", ""), ("</p></div>stray</b> ends", "stray ends"),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_page_text(k):
    source, want = PAGES[k]
    assert H.Page(source or "").text(frozenset()) == want


@pytest.mark.parametrize("wrap", ["content-sidebar-wrap", "page-with-sidebar", "layout-sidebar-right"])
def test_main_in_a_wrapper_named_for_its_layout_stays(wrap):
    for main in ("<main><p>x</p></main>", "<div role='main' class='x'><p>x</p></div>"):
        source = f"<body><div class='{wrap}'>{main}<div class='sidebar'>s</div></div></body>"
        assert H.Page(source).text(frozenset()) == "x"
    assert H.Page("<div class='sidebar'><p>s</p></div><aside><main>a</main></aside><p>t</p>").text(frozenset()) == "t"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_every_page_keeps_its_row(spark):
    rows = [(i, f"https://H{i}.example.com/x", s) for i, (s, _) in enumerate(PAGES)]
    rows += [(100, None, PAGES[0][0]), (None, "no host", PAGES[0][0]), (0, rows[0][1], PAGES[0][0])]
    pages = frame(spark, rows).withColumn("host", F.lit("x")).withColumn("tokens", F.lit(1))
    got = sorted(str((r.id, r.url, r.text)) for r in H.extract(pages).collect())
    texts = [w for _, w in PAGES] + [PAGES[0][1]] * 3
    assert got == sorted(str((i, u, w)) for (i, u, _), w in zip(rows, texts))
    assert H.extract(frame(spark, [])).count() == 0


def template_pages(n, host="https://a.example.com/", notice="All rights kept. Read this."):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, want = [], []
    for k in range(n):
        blocks = [" ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<div class='t'>{b}</div>" for b in blocks)
        rows.append((k, f"{host}{k}", f"<html><body><div class='top'>{notice}</div><div class='box'>{body}</div>"
                                      f"<div class='low'>Made by hand</div></body></html>"))
        want.append("\n\n".join(blocks))
    return rows, want


def test_template_text_goes_where_there_is_no_article(spark):
    rows, want = template_pages(30)
    for hot_share in (1, 10**6):  # met in a join, met in a broadcast
        got = {r.id: r.text for r in H.extract(frame(spark, rows), hot_share=hot_share).collect()}
        assert [got[k] for k in range(30)] == want
    few, _ = template_pages(2)  # too few pages to tell a template
    assert {r.text.split("\n\n")[0] for r in H.extract(frame(spark, few)).collect()} == {"All rights kept. Read this."}


def test_repeated_text_in_an_article_stays(spark):
    rows = [(k, "http://b.example.com/", "<article><p>the same</p><p>on all</p></article>") for k in range(20)]
    assert {r.text for r in H.extract(frame(spark, rows)).collect()} == {"the same\n\non all"}


def test_classes_are_equal_occurrence_vectors_and_nest(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        items = "<li><a>x</a></li>" * rng.randint(1, 3)
        extra = "<div><p>q</p></div>" if k % 4 else ""
        rows.append((k, "//c.example.com", f"<body><main><ul>{items}</ul>{extra}</main>{'<i>r</i>' if k < 5 else ''}</body>"))
    pages = frame(spark, rows).select(H.host_of(F.col("url")).alias("host"), F.col("page_id").alias("ph"), "html")
    got = H.templates(pages, 0.5, 4, 8).collect()
    assert len(got) == 1 and got[0].host == "c.example.com" and got[0].host_pages == 40
    vectors, parent = {}, {}
    for k, _, source in rows:
        for token, (n, up) in H.Page(source).paths.items():
            vectors.setdefault(token, {})[k] = n
            parent[token] = up
    want = {}
    for token, v in vectors.items():
        if len(v) >= 20:
            want.setdefault(tuple(sorted(v.items())), set()).add(token)
    texts = {}
    for k, _, source in rows:
        for token, _ in H.Page(source).text_tokens():
            texts.setdefault(token, {}).setdefault(k, 0)
            texts[token][k] += 1
    for token, v in texts.items():
        if len(v) >= 20:
            want.setdefault(tuple(sorted(v.items())), set()).add(token)
    assert sorted(sorted(c.tokens) for c in got[0].classes) == sorted(sorted(x) for x in want.values())
    assert all(p == 0 or p in got[0].tokens for c in got[0].classes for p in c.parents)


def test_given_pages(spark):
    """Against another way to read this known layout."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [" ".join(html.unescape(x).split()) for x in blocks]
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)


@pytest.mark.parametrize("inside, text", [
    ("<section id='discussion'><p>t</p></section>", "t"), ("<h2 id='search'>H</h2>", "H"), ("<p>a <span class='alert'>b</span> c</p>", "a b c"),
    ("<p class='notice-period'>t</p>", "t"), ("<div class='related-work'><p>t</p></div>", "t"), ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> so</p>", "if x=1 so"),
    ("<h3 class='comments'>t</h3>", "t"), ("<p id='share'>t</p>", "t"), ("<div class='notice'>t</div>", "t")])
def test_names_alone_take_no_text_out_of_an_article(inside, text):
    assert H.Page(f"<article><p>x</p>{inside}</article>").text(frozenset()) == f"x\n\n{text}"


def strip_pages(n, strip, at_least=""):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, want = [], []
    for k in range(n):
        blocks = [f"Title {k}", *(" ".join(word() for _ in range(25)) for _ in range(rng.randint(2, 4))), "The same passage on every page of it."]
        body = "".join(f"<p>{b}</p>" for b in blocks[1:])
        rows.append((k, f"https://s.example.com/{k}", f"<html><body><article><h1>{blocks[0]}</h1>{strip}{body}</article></body></html>"))
        want.append("\n\n".join(blocks))
    return rows, want


def test_an_unnamed_strip_in_the_articles_of_a_host_goes(spark):
    """By its class: its element says the same on every page. A repeated passage does not."""
    rows, want = strip_pages(20, "<div class='x1'>Read this too</div><div class='notice'><p>Late news</p></div>")
    got = {r.id: r.text for r in H.extract(frame(spark, rows)).collect()}
    assert [got[k] for k in range(20)] == want
    alone = {r.id: r.text for r in H.extract(frame(spark, rows), min_pages=21).collect()}  # no template: the strips are slots
    assert all("Read this too" in alone[k] and "Late news" in alone[k] for k in range(20))


def test_copies_of_a_page_teach_no_strip(spark):
    rows, _ = strip_pages(1, "<div class='lead'>In short</div>")
    rows = [(k, rows[0][1], rows[0][2]) for k in range(30)]
    assert all("In short" in r.text and "The same passage" in r.text for r in H.extract(frame(spark, rows)).collect())
