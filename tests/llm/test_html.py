import html as entities
import re

from pyspark.sql import functions as F

from ledgerline.llm import html, queries

CHROME = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{x:y}}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header class="site"><h1>Site name</h1><p>A slogan that is rather long, for a header.</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href='/b'>News &gt; more</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site better for you, please accept all of them today.</div>
<div class="ad">Buy this great product now, it is cheap and good, and it is only here today for you.</div>
{article}
<div class="sidebar"><p>Related stories that nobody asked for but which are quite long in themselves.</p></div>
<section id="comments"><h2>Comments</h2><p>I disagree with every word of this long and careful article, said a reader.</p></section>
<form><label>Search the whole site</label><input name=q><textarea>text</textarea></form>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_articles_in_chrome():
    p = ["First paragraph with &lt;some&gt; <em>in</em>line <a href=x>markup</a> and a\n  break<br>here.",
         "Second paragraph, of some length, about nothing in particular &mdash; really.", "Third&nbsp;one is short."]
    want = "Title here First paragraph with <some> inline markup and a break here. " \
           "Second paragraph, of some length, about nothing in particular — really. Third one is short."
    closed = "".join(f"<p>{x}</p>" for x in p)
    unclosed = "".join(f"<p><b>{x}" for x in p)
    for body in (f"<article><h1>Title here</h1>{closed}</article>", f"<ARTICLE><h1>Title here</h1>{unclosed}</ARTICLE>",
                 f"<main><div><header><h1>Title here</h1></header>{closed}</div></main>",
                 f'<div id="content"><div class=post><h1>Title here</h1>{closed}</div></div>',
                 f"<article><h1>Title here</h1><!-- <p>hidden</p> -->{closed}<div class='share-buttons'>Share it</div>"
                 f"<script>if (1 < 2) document.write('<p>x</p>')</script></article>"):
        assert html.extract(CHROME.format(article=body)) == want, body


def test_names_that_only_mention_other_parts():
    page = CHROME.format(article="<div class='layout no-sidebar has-comments'><div class='post-header'><h1>Title</h1></div>"
                                 "<div class=body><p>One paragraph of some length, as it is.</p><p>Another one, a little longer, here.</p>"
                                 "</div></div>").replace("<body", "<body id=x").replace("<nav>", "<div id='site-header'>Logo text</div><nav>")
    assert html.extract(page) == "Title One paragraph of some length, as it is. Another one, a little longer, here."


def test_odd_pages():
    assert html.extract(None) == html.extract("") == html.extract("<html><body></body></html>") == ""
    assert html.extract("plain  text\n here") == "plain text here"
    assert html.extract("<p>a<p>b") == "a b"
    assert html.extract("<div>a < b and c > d</div>") == "a < b and c > d"
    assert html.extract("<script>never closed <p>x</p>") == ""
    assert html.extract("<!-- never closed <p>x</p>") == ""
    assert html.extract("<p title='unclosed>x</p>") in ("x", "")
    assert html.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert html.extract("<ul><li>one<li>two</ul>") == "one two"
    assert html.extract("<p>x" + "</div>" * 50 + "y</p>") == "xy"
    deep = html.extract("<div>" * 20_000 + "text" + "</div>" * 20_000)
    assert deep == "text"
    assert html.extract("<article>" + "<p>word</p>" * 50_000 + "</article>") == " ".join(["word"] * 50_000)


def test_densities():
    """Counts of a small tree, and the formula at one node."""
    root = html.parse("<body><div><p>aaaa <a>bb</a></p><p>cc</p></div></body>")
    nodes = {n.tag: n for n in reversed(html.measure(root))}
    d = nodes["div"]
    assert (d.chars, d.tags, d.link_chars, d.link_tags) == (8, 3, 2, 1)
    import math
    base = math.log(8 / 6 * 2 + 2 / 8 * 8 + math.e)
    assert d.density == 8 / 3 * math.log(8 / 2 * 3 / 1) / math.log(base)


def test_query_on_generated_pages(spark, sf):
    """The pages' article element, taken by a plain pattern instead of a tree."""
    pages = {p["page_id"]: p for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op5_text_density"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        text = entities.unescape(re.sub(r"<(?:b|/b)>", "", inner).replace("<", " <"))
        want = " ".join(re.sub(r" <[^>]*>", " ", text).split())
        assert r["text"] == want
        assert r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_nulls_and_repeats_in_spark(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "<p>a</p>"), (2, "")], "page_id long, html string").withColumn(
        "text", F.lit(3))
    got = df.select("page_id", html.main_text("html").alias("t")).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", ""), ("1", ""), ("2", ""), ("None", "a")]
    assert df.limit(0).select(html.main_text("html")).count() == 0


def test_articles_split_over_blocks_of_the_body():
    p = [f"<p>{c * 100}</p>" for c in "abcde"]
    whole = " ".join(c * 100 for c in "abcde")
    for tag in ("div", "section"):
        split = f"<{tag}>{''.join(p[:3])}</{tag}><{tag}>{''.join(p[3:])}</{tag}>"
        for page in (f"<body>{split}</body>", f"<html><body>{split}</body></html>", split, f"<body><div>{split}</div></body>",
                     f"<body><{tag}>{''.join(p[:1])}</{tag}><{tag}>{''.join(p[1:])}</{tag}></body>"):
            assert html.extract(page) == whole, page
    assert html.extract(f"<body>{p[0]}<div>{''.join(p[1:])}</div></body>") == whole
    assert html.extract(f"<body><div>{''.join(p[:4])}</div>{p[4]}</body>") == whole
    links = "<div>" + "".join(f"<a href=x>link {k}</a> " for k in range(9)) + "</div>"
    assert html.extract(f"<body>{links}<div>{''.join(p)}</div>{links}</body>") == whole


def test_wrappers_named_after_parts_they_contain():
    text = "<h1>Title</h1>" + "".join(f"<p>{c * 100}</p>" for c in "abc")
    want = "Title " + " ".join(c * 100 for c in "abc")
    side = "<div class='sidebar'><p>Other stories, which nobody asked for here.</p></div><div class='page-header'>Logo</div>"
    for name in ("content-with-sidebar", "layout-sidebar-right", "fixed-header-page", "sticky-header", "search-results-article"):
        for inner in (text, f"<article>{text}</article>", f"<div class=layout-sidebar>{text}</div>", f"<main>{text}</main>"):
            for page in (f"<body><div class='{name}'>{inner}{side}</div></body>", f"<body>{side}<div id='{name}'>{inner}</div></body>",
                         f"<body><a href=x>menu</a><form id=aspnetForm><div class='{name}'>{side}{inner}</div></form></body>"):
                assert html.extract(page) == want, page
    assert html.extract(f"<body><div class=search>{text}</div></body>") == want
    assert html.extract(f"<body><form>{text}<label>Search here</label></form></body>").startswith(want)
    # parts beside an article stay cut, however long
    long = "<div><p>" + "word " * 400 + "</p></div>"
    for part in (f"<div id=comments>{long}</div>", f"<div class=comments-area>{long}</div>", f"<form>{long}</form>",
                 f"<div class=related-posts><article class=post>{long}</article></div>"):
        for main in (f"<article>{text}</article>", f"<div>{text}</div>"):
            assert html.extract(f"<body>{main}{part}</body>") == want, (part[:60], main[:20])
    assert html.extract("<div class='top-menu'>" * 5_000 + "text" + "</div>" * 5_000) == "text"


def test_pages_without_article_elements(spark, sf):
    """Generated pages keep their whole text when the article is a div, two blocks, or bare in the body."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL").orderBy("page_id").collect()]
    split = 0
    for page in pages:
        want = html.extract(page)
        m = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)
        if not m:
            continue
        inner, end = m[1], m[1].find("</p>") + 4
        forms = [f"<div>{inner}</div>", inner]
        if end > 3 and "</p>" in inner[end:]:
            two = f"<div>{inner[:end]}</div><div>{inner[end:]}</div>"
            forms += [two, f"<div>{two}</div>", f"<section><div>{inner[:end]}</div><section>{inner[end:]}</section></section>"]
            split += 1
        for form in forms:
            assert html.extract(page[:m.start()] + form + page[m.end():]) == want, form[:200]
    assert split > 0


def test_short_blocks_of_an_article():
    items = "".join(f"<li>item number {k} of the list</li>" for k in range(20))
    inner = f"<h1>Title</h1><p>A short lead.</p><ul>{items}</ul><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1</pre>"
    want = "Title A short lead. " + " ".join(f"item number {k} of the list" for k in range(20)) + " a b x = 1"
    links = "<ul>" + "".join(f"<li><a href=x>Story {k}</a></li>" for k in range(9)) + "</ul>"
    mixed = "<div>More: <a href=x>one more story</a>, <a href=x>and another story</a></div>"
    for form in (inner, f"<div>{inner}</div>", f"<div><div>{inner}</div></div>"):
        for beside in ("", links, mixed):
            assert html.extract(f"<body>{links}{form}{beside}</body>") == want, (form[:40], beside[:40])


def test_subtrees_against_brute_force():
    """Density sums, the path's threshold and the blocks beside it, by their definitions on a small tree without prose elements."""
    def block(*sizes):
        return "<div>" + "".join(f"<span>{'x' * n}</span>" for n in sizes) + "</div>"

    for sizes in ([(90, 80), (40, 40, 30), (5, 4)], [(10,), (200, 1), (9, 9, 9)], [(50,), (50,), (50,)], [(7, 7), (300,), (2, 2, 2, 2)]):
        root = html.parse("<body><div>" + "".join(block(*s) for s in sizes) + "</div></body>")
        # without links the density is characters per tag, one at least
        density = [sum(s) / len(s) for s in sizes]
        wrapper = sum(map(sum, sizes)) / sum(len(s) + 1 for s in sizes)
        body = sum(map(sum, sizes)) / (sum(len(s) + 1 for s in sizes) + 1)
        sums = {("block", k): float(sum(s)) for k, s in enumerate(sizes)} | {("wrapper", 0): sum(density), ("body", 0): wrapper}
        # of equal sums the inner one, of blocks the last
        best = max(sums, key=lambda k: (sums[k], k[0] == "block", k[1]))
        if best[0] == "wrapper":
            want = list(range(len(sizes)))
        else:
            assert best[0] == "block"
            low = min(density[best[1]], wrapper, body)
            want = [k for k in range(len(sizes)) if k == best[1] or density[k] >= low]
        got = " ".join(t for t in map(html.text_of, html.content(root)) if t)
        assert got == " ".join("x" * sum(sizes[k]) for k in want), sizes
