"""Block naming against a brute-force grouping, with every edge case of the docstring."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tradewind.llm import exact_dedup as E

ROWS = [
    (1, "a b\tc", "x"),
    (2, "abc", "y"),
    (3, "ab c  ", "z"),
    (4, None, "x"),
    (5, "", "x"),
    (6, " \n\x0b", "x"),
    (7, "abd", None),
    (8, "a\u00a0bc", "x"),
    (None, "abc", "x"),
    (2, "abc", "y"),
    (9, "Grün ß😀" * 700, "x"),
    (10, "Grün ß 😀 " * 700, "x"),
    (11, "Grün ß😀" * 699 + "Grün ß😁", "x"),
    (12, "0123456789" * 300, "x"),
    (13, "0123456789" * 301, "x"),
]


def brute(rows):
    groups = defaultdict(list)
    for at, (doc_id, text, *_) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[norm].append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            sha = hashlib.sha256(norm.encode()).hexdigest()
            doc, keep = (None if x[1] else x[2] for x in (m, best))
            out.append((doc, keep, len(members), m == best, sha))
    return sorted(out, key=str)


def result(df):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def frame(spark, rows):
    # Names that the operator uses itself must not disturb it.
    return spark.createDataFrame(rows, "doc_id long, text string, name string").withColumn("row_id", F.lit("r"))


@pytest.mark.parametrize("size", [1, 3, 64, 2048])
def test_equals_brute_force(spark, size):
    df = frame(spark, ROWS).coalesce(1)
    assert result(E.exact_duplicates(df, block_chars=size)) == brute(ROWS)


def test_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.choice([2, 5, 9]))), "s") for i in range(300)]
    assert result(E.exact_duplicates(frame(spark, rows), block_chars=2)) == brute(rows)


def test_colliding_routes_do_not_merge_contents(spark):
    """A routing key of two values: the job widens it until contents are told apart."""
    weak = lambda block, width: F.array(*[F.pmod(F.xxhash64(F.lit(i), block), F.lit(2)) for i in range(width)])
    rows = [(i, t, "s") for i, t in enumerate(["ab", "cd", "a b", "ef", "gh", "abgh"])]
    found = E.exact_duplicates(frame(spark, rows), block_chars=2, width=1, route=weak)
    assert result(found) == brute(rows)


def test_empty_table(spark):
    df = frame(spark, [])
    assert E.exact_duplicates(df).count() == 0
    assert E.drop_exact_duplicates(df).count() == 0


def test_filter_keeps_one_whole_row_of_each_group(spark):
    df = frame(spark, ROWS).coalesce(1)
    kept = E.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r[4] for r in brute(ROWS)})
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8, 10, 11, 12, 13]


def test_names_are_integers_and_no_python_runs(spark):
    found = E.exact_duplicates(frame(spark, ROWS))
    assert dict(found.dtypes)["name"] == "bigint"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_columns_with_the_names_of_helpers_stay(spark):
    from tradewind.llm import decontamination, paragraph_dedup, simhash_neardup
    from tradewind.llm.shared import unused

    names = ["_dedup_row0", "_neardup_row0", "_leak_row0", "_repeat_row0", "_REPEAT_LINES0"]
    docs = spark.createDataFrame([(1, "a b c", *range(70, 75))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        E.drop_exact_duplicates(docs),
        simhash_neardup.drop_near_duplicates(docs),
        decontamination.drop_leaks(docs, items),
        paragraph_dedup.remove_repeats(docs),
    ):
        assert out.columns == docs.columns and tuple(out.first())[2:] == tuple(range(70, 75))
    assert unused(docs, "dedup_row") == "_dedup_row1" and unused(docs, "repeat_lines") == "_repeat_lines1"
