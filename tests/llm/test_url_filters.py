from pyspark.sql import functions as F

from tradewind.llm import url_filters as U
from tradewind.llm.queries import URL_RULES

URLS = [
    "https://blog.Example.ORG/es/1?x#y",
    "http://example.org/en/12",
    "http://notexample.org/es/",
    "http://a.b.example.org/EN/1",
    "http://x.com/fr/1",
    "http://x.com/de/1",
    "http://com/de/",
    "http://example.org",
    "http://example.org?/es/",
    "http://example.org:80/es/",
    "example.org/es/",
    "",
    None,
    "://org/",
    "http://x.com/de",
    "a://b://org/es/",
    "http://ümlaut.ÖRG.org/\n/es",
    "http://" + "a." * 3000 + "com/de/" + "z" * 20000,
    "http://example.org/es/1",
    "http://example.org/es/1",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [i for i, c in enumerate(rest) if c in "/?#"]
        host = rest[: ends[0]] if ends else rest
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        tail = rest[len(host) :]
        cut = [i for i, c in enumerate(tail) if c in "?#"]
        path = tail[: cut[0]] if cut else tail
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if None not in (v, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def judged(spark, rules, urls=URLS):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    found = U.judge_urls(pages, U.rules_table(spark, rules))
    return [tuple(r)[1:] for r in found.orderBy("page_id").collect()]


def test_production_rules(spark):
    assert judged(spark, URL_RULES) == [brute(u, URL_RULES) for u in URLS]


def test_ties_repeats_and_nulls_of_rules(spark):
    rules = [
        ("allow", "org", "/es/1"),
        ("block", "example.org", "/e"),
        ("allow", "example.org", "/e"),
        ("block", "b.org", "/es"),
        ("allow", "org", "/es/1"),
        (None, "org", "/"),
        ("block", None, "/"),
        ("allow", "example.org", ""),
        ("block", "org", "/es/1/abcdef"),
    ]
    assert judged(spark, rules) == [brute(u, rules) for u in URLS]


def test_no_rules_and_no_pages(spark):
    assert {r[3] for r in judged(spark, [])} == {"allow"}
    assert judged(spark, URL_RULES, []) == []


def test_colliding_digest_prefixes_are_confirmed(spark, monkeypatch):
    """With a prefix of no digits every expression meets every rule; digests decide."""
    monkeypatch.setattr(U, "PREFIX_DIGITS", 0)
    assert judged(spark, URL_RULES) == [brute(u, URL_RULES) for u in URLS]


def test_no_python_and_no_cross_join(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    plan = U.judge_urls(pages, U.rules_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert word not in plan
