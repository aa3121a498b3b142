"""Main text: page forms, tables, the merged tree against a plain count, and defined edge cases."""

import html
import math
import re
from collections import Counter

import pytest

pytest.importorskip("quernstone.llm")
from quernstone.llm import queries, site_tree  # noqa: E402

CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<article>x<b>y</b> z</article>", "xy z"),
    ("<body><nav>m</nav><main><h1>T</h1><p>a\n  b</p><aside>s</aside></main><footer>f</footer>", "T a b"),
    ("<article><p>one<br>two</p><script>var a='</p><p>no';</script><style>p{}</style><!-- c --><form>q<input></form></article>", "one two"),
    ("<article><p>keep</p><div class='comments'><p>c</p></div><section id=user-comments>d</section></article><div class=ad-slot>x</div>", "keep"),
    ("<article class='post comment-closed-no'>x</article>", "x"), ("<article class='post-12 comments-open share'>x</article>", "x"), ("<div class='search results'><article>y</article></div>", "y"),
    ("<body class=has-sidebar><div id=comments><article class=comment>c</article></div><article>z</article>", "z"), ("<div class=no-sidebar><p>kept</p></div><div class=sidebar>s</div>", "kept"),
    ("<div id=cookieNotice>c</div><div class=content><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></div>", "a b 1 2"),
    ("<article><p>unclosed <i>it<p>next &#233;&nbsp;&lt;b&gt; &copy", "unclosed it next é <b> ©"),
    ("<article><p title=\"a > b\">q</p><p data-x='<p>'>r</p></article>", "q r"),
    ("<article>a < b and c</article>", "a < b and c"), ("<article>x<div hidden>h</div><div style='display: none'>n</div><div role=navigation>m</div>y</article>", "x y"),
    ("<title>t</title><p>body</p>", "body"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"), ("<article><p>" + "w " * 50_000 + "</p></article>", ("w " * 50_000).strip()),
    ("<article><svg><text>s</text></svg><noscript>n</noscript><header><h1>h</h1></header><p>t", "t"), ("<p", ""), ("<article>a</article><article>b</article><p>c</p>", "a b"),
]


def test_forms(spark):
    """Each page on a host of its own, where only what a branch says of itself can tell."""
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", page) for i, (page, _) in enumerate(CASES)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_tree.extract(pages).collect()} == {i: text for i, (_, text) in enumerate(CASES)}


def plain_tree(pages):
    """Occurrences and importance of each node, from Page.branches alone, counted with dictionaries."""
    seen = {}
    for host, page in pages:
        for key, _, weight, text, around, layout in site_tree.Page(page).branches():
            rows = seen.setdefault((host, key), ({}, weight))[0]
            rows[text, around] = min(layout, rows.get((text, around), layout))
    out = {}
    for node, (rows, weight) in seen.items():
        m = len(rows)
        texts, layouts = Counter(t for t, _ in rows), Counter(rows.values())
        left = lambda c: 1 - sum(n * math.log(n) for n in c.values()) / (m * math.log(m)) if m > 1 else 1.0  # noqa: B023, E731
        out[node] = (weight, m, (1 - site_tree.GAMMA) * left(layouts) + site_tree.GAMMA * left(texts))
    return out


def test_tree_and_text_against_plain_counts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", site_tree.host_of("url"))
    rows = pages.collect()
    want = plain_tree([(r.host, r.html) for r in rows])
    got = {(r.host, r.key): (r.weight, r.occurrences, r.importance) for r in site_tree.style_tree(pages).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-9) for k in want)
    low = {}
    for (host, key), (weight, _, importance) in want.items():
        if weight * importance < site_tree.LEAST:
            low.setdefault(host, set()).add(key)
    text = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    assert all(text[r.page_id] == site_tree.Page(r.html).main_text(low.get(r.host, set())) for r in rows)
    assert all(text[r.page_id] != site_tree.Page(r.html).main_text(set()) for r in rows)


def test_inside_articles_and_among_copies(spark):
    """Repeated unnamed branches go inside an article too; copied pages, alone or among others, and dominant nodes keep their text."""
    say = lambda i: f"story {i} " * 9
    rows = [(i, "http://a.example", f"<article><p>{say(i)}</p><div class=x9>Read our terms</div></article>") for i in range(30)]
    rows += [(100 + i, "http://copies.example", f"<body><nav>n{i}</nav><div class=c><p>{say(0)}</p></div></body>") for i in range(5)]
    rows += [(200 + i, "http://hot.example", f"<body><div class=c><p>{say(0 if i < 45 else i)}</p></div><div class=by>author {i}</div></body>") for i in range(50)]
    out = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert all(out[i] == say(i).strip() for i in range(30))
    assert all(out[100 + i] == say(0).strip() for i in range(5))
    assert all(out[200 + i].startswith(say(0 if i < 45 else i).strip()) for i in range(50))


def test_time_is_linear_in_depth():
    page = site_tree.Page("<div>" * 60_000 + "deep" + "</div>" * 60_000)
    assert page.main_text({key for key, *_ in page.branches()}) == "deep"


def article_by_pattern(page):
    body = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)[1]
    blocks = re.split(r"<[^b/][^>]*>|<br>|</(?:p|h1)>", body)
    return " ".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_tables(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op2_site_tree_text(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert (r.text, r.n_chars, r.url) == (article_by_pattern(pages[r.page_id].html), len(r.text), pages[r.page_id].url)


def test_tree_removes_what_repeats(spark):
    """Without words that tell, boilerplate goes by its importance and the body stays, also when one host has nearly all pages."""
    body = lambda i: f"story {i} " * 5
    page = lambda i: f"<body><div class=t1>Always the same line</div><div class=t2><p>{body(i)}</p></div><div class=t3>End of all</div></body>"
    rows = [(i, "http://User@A.example/x" if i % 2 else "https://a.example", page(i), "z") for i in range(40)] + [(100, "http://b.example", page(100), "z"), (101, None, page(101), "z"), (None, "http://c.example", None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in site_tree.extract(pages).collect()}
    assert all(out[i] == body(i).strip() for i in range(40))
    assert out[100] == f"Always the same line {body(100)}End of all" and out[None] == ""
    tree = {(r.host, r.name): r for r in site_tree.style_tree(pages.select(site_tree.host_of(pages.url).alias("host"), "html")).collect()}
    assert tree["a.example", "div.t1"].occurrences == 40
    assert tree["a.example", "div.t1"].importance == pytest.approx(0, abs=1e-9)
    assert tree["a.example", "div.t2"].importance == pytest.approx(0.9, abs=1e-9)
    assert site_tree.extract(pages.limit(0)).count() == 0


def test_wide_list_is_joined(spark, sf, monkeypatch):
    monkeypatch.setattr(site_tree, "MAX_BROADCAST_NODES", -1)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(r.text for r in site_tree.extract(pages).collect()) == sorted(r.text for r in queries.op2_site_tree_text(spark, sf).collect())
