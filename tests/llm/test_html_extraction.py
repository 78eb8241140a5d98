import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tradewind.llm import html_extraction as H

ALONE = H._Site(None, None)

PAGES = [
    ("<p>a<b>b</b>c<br>d</p>e", "abc d e"),
    ("<p><b>one<p>two <i>3\n\t4</i><p>", "one two 3 4"),
    ("a &lt;b&gt; &amp;amp; &#65; 1 < 2 <3 &nbsp; x", "a <b> &amp; A 1 < 2 <3 x"),
    ("<script>var t='</p><p>x';</script>y<style>p{}</style><textarea><p>no</textarea>z", "y z"),
    ("<!-- <p>no</p> -->a<!-->b<!doctype html>c<?php x ?>d", "abcd"),
    ("<title>no</title><nav>no<p>no</nav>yes<header>no</header><footer>no", "yes"),
    ("<div class='page-Sidebar2'>no</div><div id=cookieNotice>no</div><div class=advice>yes</div>", "yes"),
    ("<form><label>no</label><input value=no></form>yes<ul><li>one<li>two</ul>", "yes one two"),
    ("<div class=comments><article class=comment>no</article></div><article><h1>T</h1>x</article>rest", "T x"),
    ("<article><header><h1>T</h1></header><p>x<aside>no</aside>y<div class='share links'>no</div></article>", "T x y"),
    ("<form id=all><nav>no</nav><article>x<form>no</form></article></form>", "x"),
    ("<main>in<article>most</article></main>", "most"),
    ("<body class='has-sidebar'><main>in</main>out", "in"),
    ("<ul><li><a href=/1>no no</a><li><a href=/2>no no</a><li><a href=/3>no no</a></ul>yes", "yes"),
    ('<article><p title="a > b">x</p><p class="never ends>y</p>z</article>', "x y z"),
    ("<table><tr><td>a<td>b<tr><th>c</table>d</table></div></p>e", "a b c d e"),
    ("<script>no", ""),
    ("<p", ""),
    ("", ""),
    ("plain\x00 text　with \U0001f600", "plain\x00 text with \U0001f600"),
    ("<div>" * 3000 + "deep" + "</span>" * 50, "deep"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_single_pages(page, want):
    assert H.main_text(page, ALONE) == want


def test_long_pages_cost_their_length():
    assert H.main_text('<a "' * 200_000, ALONE) == ""
    assert H.main_text("<p>x" * 50_000, ALONE) == " ".join(["x"] * 50_000)


def page(top, texts, foot="same foot"):
    body = "".join(f"<p>{t}</p>" for t in texts)
    return f"<html><body><div class='a1'>{top}</div><div class='b'>{body}</div><div class='c'>{foot}</div></body></html>"


def site(host, n, same="one line for all", copies=0):
    own = [(f"http://{host}/{i}", page(same, [f"text {host} {i} {j}" for j in range(1 + i % 4)])) for i in range(n)]
    return own + [(f"http://{host}/c{i}", page(same, ["copied", "words"])) for i in range(copies)]


ROWS = [
    *site("big.org", 30, copies=60),
    *site("few.org", 3),
    (None, page("one line for all", ["x"])),
    ("no host", page("one line for all", ["y"])),
    ("http://big.org/null", None),
    ("http://big.org/1", page("one line for all", ["said twice"])),
    ("http://big.org/1", page("one line for all", ["said twice"])),
]


def extracted(spark, rows, parts=5):
    frame = spark.createDataFrame([(i, u, h, "x", 1.5) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, host double")
    found = H.main_texts(frame.repartition(parts))
    assert found.columns == ["page_id", "url", "text"]
    return {r.page_id: (r.url, r.text) for r in found.collect()}


def test_texts_that_a_site_repeats_go_and_copies_stay(spark):
    found = extracted(spark, ROWS)
    assert len(found) == len(ROWS)
    for i, (url, html) in enumerate(ROWS):
        got = found[i][1]
        assert found[i][0] == url
        if url and "big.org" in url:
            assert "one line" not in got and "same foot" not in got
            want = "copied words" if "/c" in url else None if "null" in url else "said twice" if html == ROWS[-1][1] else "text big.org"
            assert got == "" if want is None else got.startswith(want)
        else:
            assert got.startswith("one line for all") and got.endswith("same foot")


def test_marked_articles_lose_only_what_most_pages_show(spark):
    rows = [
        (f"http://a.org/{i}", f"<article><p>Subscribe to us</p><p>text {i}</p><p>{'third' if i % 3 == 0 else i}</p></article>")
        for i in range(30)
    ]
    found = extracted(spark, rows)
    assert [found[i][1] for i in range(30)] == [f"text {i} {'third' if i % 3 == 0 else i}" for i in range(30)]


def test_site_trees_equal_brute_force(spark):
    frame = spark.createDataFrame(ROWS, "url string, html string").repartition(4)
    frame = frame.withColumn("host", F.coalesce(F.regexp_extract("url", "//([^/]*)", 1), F.lit("")))
    found = {r.host: r for r in H.site_trees(frame).collect()}
    assert set(found) == {"big.org"}
    pages = defaultdict(lambda: defaultdict(set))
    for url, html in ROWS:
        if url and "big.org" in url:
            nodes = H.parsed(html or "")
            sign = "\n".join(b.text for b in H.kept_branches(nodes)[0])
            pages[0][None].add(sign)
            for n in nodes[1:]:
                key = (n.path, n.text is None)
                pages[key][n.text if n.text is not None else tuple(dict.fromkeys(c.path for c in n.children if c.text is None))].add(sign)
    m = len(pages.pop(0)[None])
    assert found["big.org"].site_pages == m == 33
    want = Counter()
    for (path, layout), shown in pages.items():
        counts = [len(s) for s in shown.values()]
        total = sum(counts)
        if layout and total >= max(2, m * H.SHARE):
            entropy = -sum(k / total * math.log(k / total, total) for k in counts)
            want[path, True, total, round(entropy, 9) + 0.0, len(counts)] += 1
        elif not layout:
            for k in counts:
                if k >= max(2, m * H.SHARE):
                    want[path, False, k, None, 0] += 1
    got = Counter(
        (n.path, n.layout, n.pages, None if n.importance is None else round(n.importance, 9) + 0.0, n.kinds)
        for n in found["big.org"].tree
    )
    assert got == want


def test_empty_table(spark):
    assert extracted(spark, []) == {}


def test_the_query_keeps_articles_of_given_pages_whole(spark):
    import html
    import re

    from tradewind.llm import queries

    given = queries.table(spark, "/root/testdata/sf0.001", "pages").collect()
    found = {r.page_id: r for r in queries.QUERIES["op13_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(given)
    for row in given:
        article = re.search("(?s)<article>(.*)</article>", row.html).group(1)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert (found[row.page_id].text, found[row.page_id].n_chars) == (want, len(want))
