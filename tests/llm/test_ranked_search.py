import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tradewind.llm import queries
from tradewind.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    words = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    out = []
    for item, text in items:
        scores = []
        for doc_id, found in words:
            score = 0
            for t in set(terms(text)):
                if tf := found.count(t):
                    df = sum(t in w for _, w in words)
                    m = 100 - 50 + 50 * len(found) * n_docs // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1000000000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def corpus(size=90):
    rng = random.Random(7)
    vocabulary = ["the", "a", "É-té", "x1", "日本", "word", *(f"w{i}" for i in range(40))]
    rows = [(i, " ".join(rng.choices(vocabulary, [60, 40, 9, 8, 7, 6, *[1] * 40], k=rng.randint(1, 40)))) for i in range(size)]
    rows += [(200 + i, rows[3][1]) for i in range(25)]
    return [*rows, (500, None), (501, ""), (502, "... !?"), (None, rows[3][1]), (3, rows[3][1]), (503, "The " * 3000)]


ITEMS = [
    (1, "The w1 w2, W3 é-té!"),
    (2, "A x1 日本 x1 word"),
    (3, None),
    (4, "no-such TERM"),
    (5, " ".join(f"w{i}" for i in range(30))),
    (5, "w7"),
    (None, "w9 the"),
]


def search(spark, docs, items, parts=3, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = R.ranked_search(frame.withColumn("rank", F.lit(0)).withColumn("item_id", F.lit("x")), asked, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(
    "more",
    [{}, {"block_docs": 7, "top": 4}, {"block_docs": 16, "round_terms": 5, "top": 30}, {"stage_shares": (0.01, 0.02, 0.05, 0.3, 1.0)}],
)
def test_equals_brute_force(spark, more):
    docs = corpus()
    assert search(spark, docs, ITEMS, **more) == brute(docs, ITEMS, more.get("top", 50))


def test_partitions_do_not_matter(spark):
    docs = corpus(40)
    assert search(spark, docs, ITEMS, parts=1, top=5) == search(spark, docs, ITEMS, parts=9, top=5, block_docs=3)


def test_nothing_to_find(spark):
    assert search(spark, [], ITEMS) == []
    assert search(spark, corpus(5), []) == []
    assert search(spark, [(1, None), (2, "")], ITEMS) == []


def test_sql_of_the_query_equals_brute_force():
    docs, items = [r for r in corpus() if r[0] is not None], [r for r in ITEMS if r[0] not in (None, 5)]
    with duckdb.connect() as db:
        for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
            db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        found = db.execute(queries.SQL["op11_ranked_search"]).fetchall()
    assert sorted(found, key=repr) == brute(docs, items)
