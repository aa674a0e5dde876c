"""Style-tree extraction."""

import html
import math
import re

from lexspark.llm.styletree import extract_articles, kept_blocks, low_nodes


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in extract_articles(pages).collect()}


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract_articles(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_entropy_finds_unmarked_boilerplate(spark):
    def page(i):
        body = "".join(f"<p>story {i} part {k} with words {i * k}</p>" for k in range(4))
        return f"<html><body><div class='x1'>Home | News | About us</div><div class=c{'' if i % 2 else 7}>{body}</div><div class='x2'>All rights belong to Us Ltd</div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(99, "http://b.example/1", page(99))]
    got = texts(spark, rows)
    assert got[3] == "\n".join(f"story 3 part {k} with words {3 * k}" for k in range(4))
    # one page alone tells nothing about its site
    assert got[99].startswith("Home | News | About us\nstory 99")


def test_marks_and_broken_pages(spark):
    rows = [
        (1, "u", "<body><header>Site</header><div id='cookie-notice'>We use cookies</div><main><h1>T &amp; t</h1><p>One<br>two <b>three</i>\n four<p>Five<ul><li>a<li>b</ul><form>x<input></form><aside>y</aside></main><section class=comments><article>me too</article></section><footer>z"),
        (2, None, None), (3, "", ""), (4, "http://h/x", "plain text &lt;b&gt; here"), (5, "u", "<div class='ad'>buy<article><p>kept &#233;&nbsp;x</p></article>"),
        (6, "u", "<p>a</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>b"), (6, "u", "<p>a"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text) for r in extract_articles(pages).collect())
    assert got == [(1, "T & t\nOne two three four\nFive\na\nb"), (2, ""), (3, ""), (4, "plain text <b> here"), (5, "kept é x"), (6, "a"), (6, "a\nb")]


def test_copies_do_not_make_an_article_low(spark):
    page = "<html><body><div><p>the same long article on every page of the host</p></div></body></html>"
    pages = spark.createDataFrame([("h", page)] * 50, "host string, html string")
    assert low_nodes(pages).collect() == []


def test_near_copies_do_not_delete_the_text_of_pages(spark):
    def page(i, near, wrap):
        parts = [f"shared paragraph {k} of the notice" if near and k else f"page {i} says {'a long thing ' * 5}in part {k}" for k in range(10)]
        parts = ["Notice of terms" if near else f"Title of {i}", *parts]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        return f"<body><div class=x1>Home | News</div>{wrap[0]}{body}{wrap[1]}</body>", "\n".join(parts)

    for wrap in (("", ""), ("<article>", "</article>")):
        made = [page(i, i % 10 != 0, wrap) for i in range(200)]
        got = texts(spark, [(i, f"http://a.example/{i}", p) for i, (p, _) in enumerate(made)])
        assert [got[i] for i in range(200)] == [want for _, want in made]


def test_only_common_texts_leave_a_low_node(spark):
    def page(i):
        return f"<body><div class=x1>{'One text of this page' if i == 7 else 'Home | News'}</div><div class=c>story {i} of the site</div></body>"

    got = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(40)])
    assert got[7] == "One text of this page\nstory 7 of the site" and got[3] == "story 3 of the site"


def test_article_elements_keep_low_nodes(spark):
    def page(i):
        return f"<body><article><h2>Summary</h2><p>story {i} of the site</p></article></body>"

    got = texts(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(20)])
    assert got[3] == "Summary\nstory 3 of the site"


def kept(page):
    return [t for _, t in kept_blocks(page)]


def test_marks_are_priors():
    assert kept("<article><p>Main</p></article><aside class='related'><article><p>Teaser</p></article></aside>") == ["Main"]
    assert kept("<article><p>Main</p><div class='related'><article><p>Teaser</p></article></div></article>") == ["Main"]
    assert kept("<body class='has-sidebar'><h1>T</h1><p>Text</p></body>") == ["T", "Text"]
    assert kept("<div class='page sidebar'><h1>T</h1><p>Text of the page</p></div><div class='sidebar'><p>Links</p></div>") == ["T", "Text of the page"]
    assert kept("<article><div class='post-header'><h1>Title</h1></div><p class='notice'>Kept</p><p title='a hidden gem'>Gem</p></article>") == ["Title", "Kept", "Gem"]
    assert kept("<article><p>A</p><p hidden>B</p><p style='display: none'>C</p><p aria-hidden=true>D</p><div class='user-feedback'><p>me too</p></div></article>") == ["A"]


def test_tree_decides_inside_articles(spark):
    def page(i):
        return (f"<body><article><h1>Story {i}</h1><p>story {i} of the site is told here in {i * 7} words and some more of them</p><h2>Summary</h2>"
                f"<p>part {i} and {i * i}</p><div class=x9><h3>Stay</h3><p>Mail me</p></div></article></body>")

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)]
    want = {i: f"Story {i}\nstory {i} of the site is told here in {i * 7} words and some more of them\nSummary\npart {i} and {i * i}" for i in range(20)}
    assert texts(spark, rows) == want
    # without the tree the box stays; lists that are joined give the same
    assert [t for _, t in kept_blocks(page(3))][-2:] == ["Stay", "Mail me"]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in extract_articles(pages, broadcast_bytes=0).collect()} == want


def test_importance_equals_brute_force(spark):
    """A host's low nodes against entropies of a flat site counted by hand."""
    n = 32
    rows = [("h", f"<div class=a><p>same words here</p></div><div class=b><p>text {i} of {i * 3}</p></div><div class=c><p>{'odd' if i % 2 else 'even'} page</p></div>") for i in range(n)]
    got = low_nodes(spark.createDataFrame(rows, "host string, html string")).collect()
    path = {}
    for node, text in kept_blocks(rows[0][1]):
        path[text.split()[0]] = (node.key, node.parent.key)

    def importance(counts):  # of texts with these page counts
        weight = sum(math.sqrt(k) for k in counts)
        return sum(math.sqrt(k) * (1 - math.log(k) / math.log(n)) for k in counts) / weight

    low = set()
    for word, counts in (("same", [n]), ("text", [1] * n), ("even", [n // 2] * 2)):
        own, above = path[word]
        content = importance(counts)  # every parent has one child sequence: presentation 0
        low |= {own} if content < 0.3 else set()
        low |= {above} if 0.9 * content < 0.3 else set()
    assert len(got) == 1 and set(got[0].low) == low and len(low) == 4


def test_very_long_page_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(60000)) + "</article>"
    pages = spark.createDataFrame([(1, "http://a/1", long, "x", 7), (2, None, "<p>b", None, None)], "page_id bigint, url string, html string, text string, low int")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_articles(pages).collect()}
    want = "\n".join(f"part {i}" for i in range(60000))
    assert got == {1: (want, len(want)), 2: ("b", 1)}


def test_empty_table(spark):
    assert texts(spark, []) == {}
