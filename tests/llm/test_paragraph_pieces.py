"""Passages inside longer lines and over line breaks, found by content-chosen pieces."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tradewind.llm import paragraph_dedup as D
from tradewind.llm import queries
from tradewind.llm.wordhash import words

SIZE, STARTS = 25, 26


def tokens(text):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def corpus(seed=3, planted=40):
    """Documents of which some share passages of 51 words and more, in lines cut at other places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, pairs = [], []
    for p in range(planted):
        passage = [word() for _ in range(rng.randint(51, 120))]
        ids = []
        for _ in range(rng.choice([2, 2, 3])):
            before, after = ([word() for _ in range(rng.randint(0, 150))] for _ in range(2))
            text = [rng.choice([w, w.upper()]) if rng.random() < 0.2 else w for w in [*before, *passage, *after]]
            joined = "".join(w + rng.choice([" ", " ", " ", " ", ", ", "\n", "\n\n"]) for w in text)
            ids.append(len(docs))
            docs.append((len(docs), joined))
        pairs.append(ids)
    clean = [(1000 + i, " ".join(word() for _ in range(rng.randint(0, 400)))) for i in range(60)]
    return [*docs, *clean], pairs


def run(spark, docs, parts=4):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return D.repeated_pieces(frame.withColumn("row_id", F.lit(1)).withColumn("word", F.lit("x"))).collect()


def test_every_planted_passage_is_found_and_clean_documents_are_not(spark):
    docs, pairs = corpus()
    rows = run(spark, docs)
    assert {r.doc_id for r in rows} == {i for ids in pairs for i in ids}
    for ids in pairs:
        assert {r.first_doc for r in rows if r.doc_id in ids} == {min(ids)}
        assert sum(r.kept for r in rows if r.doc_id in ids) == 1


def test_listed_passages_are_equal_words(spark):
    docs, _ = corpus(5)
    text = {i: tokens(t) for i, t in docs}
    rows = run(spark, docs)
    assert len(rows) > 80
    for r in rows:
        here = text[r.doc_id][r.first_word : r.first_word + r.n_words]
        assert r.n_words >= SIZE and here == text[r.first_doc][r.source_word : r.source_word + r.n_words]


def test_choice_equals_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice("abc") * 3 + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 150))) for _ in range(4)]
        part = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        offsets = np.cumsum([0, *[len(t.encode()) + 1 for t in texts[:-1]]])
        begins, _, hashes = words(part)
        doc = np.searchsorted(offsets, begins, "right") - 1
        own = D.runs(hashes, SIZE)
        want = set()
        for i in range(len(hashes) - SIZE - STARTS + 2):
            if doc[i] == doc[i + SIZE + STARTS - 2]:
                low = own[i : i + STARTS].min()
                want |= {i + k for k in range(STARTS) if own[i + k] == low}
        assert D._chosen(hashes, doc, SIZE, STARTS).tolist() == sorted(want)


def test_copies_nulls_ties_and_short_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    same = "tick " * 300
    docs = [(1, long), (1, long), (None, long.upper()), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(49))), (7, same), (8, same), (9, same + same)]
    rows = run(spark, docs)
    assert {r.doc_id for r in rows} == {1, None, 7, 8, 9}
    assert {(r.first_doc, r.source_word) for r in rows if r.doc_id in (1, None)} <= {(1, w) for w in range(60)}
    assert {r.first_doc for r in rows if r.doc_id in (7, 8, 9)} == {7}
    assert run(spark, [(7, same)]) == [] and run(spark, []) == []


def test_two_long_lines_of_equal_polynomials_are_two_classes():
    """Sequences that agree under any polynomial modulo a power of two."""
    bits = np.array([bin(i).count("1") & 1 for i in range(1024)])
    both = np.concatenate([bits, 1 - bits])
    _, _, hashes = words(np.frombuffer("".join("ab " if b else "cd " for b in both).encode(), np.uint8))
    c1, c2 = D._class_hashes(hashes, np.array([0, 1024]), np.array([1024, 1024]))
    assert c1[0] != c1[1] and c2[0] != c2[1]


def test_query_lists_lines_and_pieces(spark):
    found = queries.QUERIES["op9_paragraph_dedup"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "line", "n_words", "first_doc", "first_line", "group_size", "kept", "first_word", "source_word"]
    assert found.filter("line IS NOT NULL").count() > 0 and found.filter("first_word IS NOT NULL").count() > 0
    assert found.filter("(line IS NULL) = (first_word IS NULL)").count() == 0
