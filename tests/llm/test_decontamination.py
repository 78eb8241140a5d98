import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import decontamination as D
from tradewind.llm import queries, wordhash

SF = "/root/testdata/sf0.001"


#: Punctuation and blanks beyond ASCII part words; such characters are words of their own.
SIGNS = r"\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u207f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20"
SINGLE = r"\u3040-\u30ff\u3400-\u9fff"


def tokens(text):
    return re.findall(rf"[{SINGLE}]|(?:(?![{SIGNS}{SINGLE}])[0-9a-z_\u0080-\U0010ffff])+", (text or "").lower())


def slow_tiles(item, text, minimum):
    """Greedy string tiling as defined: mark the longest common run of free words, repeat."""
    p_free, t_free, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and p_free[i + k] and t_free[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < minimum:
            return total
        p_free[i : i + k] = [False] * k
        t_free[j : j + k] = [False] * k
        total += k


def brute(docs, items, seed=5, coverage=0.8):
    out = []
    for i, text, *_ in items:
        p = tokens(text)
        for d, doc, *_ in docs:
            if p and slow_tiles(p, tokens(doc), min(seed, len(p))) >= coverage * len(p):
                out.append((d, i))
    return sorted(out, key=str)


A = "What is the capital city of the old northern kingdom, and when was it first founded by settlers?"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ITEMS = [(1, A), (2, B), (3, "Short one"), (4, ""), (5, None), (6, "... !"), (7, "a a a a a a a a a a a a"), (2, B), (None, "Was ist das für ein Größenwahn?")]
W = B.split()
DOCS = [
    (1, "before " + A.upper() + " after"),
    (2, " ".join(W[10:] + ["x"] + W[:10])),
    (3, " ".join(W[15:] + ["y"] + W[5:10] + ["z"] + W[10:15] + ["q"] + W[:5])),
    (4, " ".join(W[:16])),
    (5, " ".join(W[:15])),
    (6, " ".join(W[:5] + ["no"] + W[6:10] + ["no"] + W[11:])),
    (7, "a short one."),
    (8, "short two one"),
    (9, None),
    (10, ""),
    (11, "a " * 30),
    (12, "a a a"),
    (13, "filler words go on " * 50_000 + A + " filler" * 10),
    (14, "WAS IST DAS FÜR EIN GRÖSSENWAHN was ist das für ein größenwahn"),
    (None, B),
    (15, B),
    (15, B),
    (16, A[:40]),
    (17, "capital city of the old northern kingdom and"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, at string").withColumn("row_id", F.lit(1)),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, seeds string"),
    )


@pytest.mark.parametrize("block", [2_000_000, 6])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_SEEDS", block)
    docs, items = frames(spark)
    got = sorted(((r.doc_id, r.item_id) for r in D.leaked_items(docs, items).collect()), key=str)
    assert got == brute([d for d in DOCS if d[0] != 13], ITEMS) + [(13, 1)] or got == sorted(
        brute([d for d in DOCS if d[0] != 13], ITEMS) + [(13, 1)], key=str
    )
    assert (3, 2) in got and (2, 2) in got and (5, 2) not in got and (6, 2) not in got


def test_random_reordered_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = tokens(rng.choice(items)[1])
        cuts = sorted(rng.sample(range(1, len(words)), min(rng.randrange(0, 4), len(words) - 1)))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        rng.shuffle(parts)
        docs.append((d, " ".join(" ".join(p) + " " + rng.choice(vocabulary) for p in parts)))
    got = sorted(((r.doc_id, r.item_id) for r in D.leaked_items(*frames(spark, docs, items)).collect()), key=str)
    assert got == brute(docs, items)


def test_tiles_lie_where_they_say():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        text = [rng.choice([0, 1, 2, 3, None]) for _ in range(rng.randrange(1, 60))]
        low = rng.randrange(1, 5)
        found = D.tiles(item, text, low)
        used_p, used_t = set(), set()
        for i, j, k in found:
            assert k >= low and item[i : i + k] == text[j : j + k]
            assert not used_p & set(range(i, i + k)) and not used_t & set(range(j, j + k))
            used_p |= set(range(i, i + k))
            used_t |= set(range(j, j + k))


def test_filter_and_empty_tables(spark):
    docs, items = frames(spark)
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    gone = {d for d, _ in brute([d for d in DOCS if d[0] != 13], ITEMS)} | {13}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d[0] for d in DOCS if d[0] not in gone), key=str)
    assert D.leaked_items(docs.limit(0), items).count() == 0
    assert D.leaked_items(docs, items.limit(0)).count() == 0
    assert D.drop_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_words_do_not_depend_on_the_cut(monkeypatch):
    text = ("Ab c_d é, 東京!  " * 40 + "z" * 500 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    whole = wordhash.words(data)
    monkeypatch.setattr(wordhash, "PIECE", 16)
    cut = wordhash.words(data)
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert len(wordhash.words(np.frombuffer(b" ,.", np.uint8))[0]) == 0


def test_query(spark):
    got = sorted((r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontamination"](spark, SF).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = []
    for i, text in items:
        p = tokens(text)
        runs = {tuple(p[k : k + 5]) for k in range(len(p) - 4)}
        for d, doc in docs:
            t = tokens(doc)
            if runs & {tuple(t[k : k + 5]) for k in range(len(t) - 4)} or len(p) < 5:
                near.append((d, i, p, t))
    want = sorted((d, i) for d, i, p, t in near if slow_tiles(p, t, min(5, len(p))) >= 0.8 * len(p))
    assert got == want and want


def test_typographic_punctuation_and_running_chinese(spark):
    item = "It's a plain item - with quotes, dashes... and \"some\" more words to be found here"
    curly = "before “It’s a plain item — with quotes, dashes… and «some» more words to be found here” after"
    chinese, running = "今天天气很好我们去公园散步吧", "他说今天天气很好我们去公园散步吧然后回家"
    docs = [(1, curly), (2, running), (3, "今天 天气 不 好"), (4, "plain words of no item at all")]
    items = [(1, item), (2, chinese)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = D.leaked_items(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == brute(docs, items) == [(1, 1), (2, 2)]


def test_words_beyond_ascii_equal_a_pattern():
    rng = random.Random(8)
    signs = ["a", "Z", "9", "_", "é", "ß", "ž", "“", "—", "…", "\u00a0", "«", "º", "µ", "×", "中", "日", "カ", "。", "，", "ｗ", " ", ".", "\n", "😀", "კ"]
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40))).lower() + " "
        raw = text.encode()
        starts, ends, _ = wordhash.words(np.frombuffer(raw, np.uint8))
        assert [raw[s:e].decode() for s, e in zip(starts, ends)] == tokens(text)


def test_workers_without_the_package(tmp_path):
    """The job runs where the workers can't import the package; only the driver has it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tradewind.session import local_session
from tradewind.llm import decontamination, ranked_search, run_detection, html_extraction
spark = local_session(2, 2, "1g")
assert spark.range(1).mapInArrow(lambda b: (x for x in b if __import__("importlib").util.find_spec("tradewind") is None), "id long").count() == 1
text = "one two three four five six seven eight"
docs = spark.createDataFrame([(1, "x " + text)], "doc_id long, text string")
items = spark.createDataFrame([(7, text)], "item_id long, text string")
assert decontamination.leaked_items(docs, items).count() == 1
assert ranked_search.ranked_search(docs, items).count() == 1
assert run_detection.run_report(run_detection.periodic_runs(docs)).count() == 1
pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
assert html_extraction.main_texts(pages).first().text == "x"
print("all found")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all found" in done.stdout, done.stderr[-3000:]
