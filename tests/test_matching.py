import difflib
import random

import pytest
from pyspark.sql import functions as F

from tradewind.functions import matching
from tradewind.operators.entities import fuzzy_match_stores


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).quick_ratio()


def jaccard(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


def brute(name, stores):
    best, best_score = None, 0.0
    for sid, sname in stores:
        score = max(ratio(name, sname), 0.9 * jaccard(name, sname))
        if score > best_score:
            best, best_score = (sid, sname), score
    return (*best, best_score) if best and best_score >= 0.9 else (None, None, 0.0)


def random_names(n, seed):
    rng = random.Random(seed)
    words = ["შპს", "სს", "ორი", "ნაბიჯი", "ნიკორა", "ლაქი", "ზღაპარი", "სმარტ", "რითეილ", "გვირილა", "Ltd"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)]


def scan(name, rng):
    kind = rng.randint(0, 4)
    if kind == 0:
        return name
    if kind == 1:
        return " ".join(reversed(name.split()))
    i = rng.randrange(len(name))
    if kind == 2:
        return name[:i] + name[i + 1 :]
    if kind == 3:
        return name[:i] + "ხ" + name[i + 1 :]
    return name[:i] + "ჭჭ" + name[i:]


def test_char_ratio_and_jaccard(spark):
    a = random_names(100, 1) + ["", "aab", "აბგ"]
    b = random_names(100, 2) + ["", "abb", ""]
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    got = df.select(
        "a", "b",
        matching.char_ratio(F.col("a"), F.col("b")).alias("r"),
        matching.token_jaccard(F.col("a"), F.col("b")).alias("j"),
    ).collect()
    for row in got:
        assert row.r == pytest.approx(ratio(row.a, row.b), abs=1e-12)
        assert row.j == pytest.approx(jaccard(row.a, row.b), abs=1e-12)


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(7)
    stores = list(enumerate(random_names(60, 3), start=1))
    names = sorted({n for n in (scan(s, rng) for _, s in stores * 4) if n} | {"უცხო სახელი"})
    got = fuzzy_match_stores(
        spark.createDataFrame([(n,) for n in names] * 2, "name string"),
        spark.createDataFrame(stores, "id long, name string"),
    ).collect()
    assert len(got) == len(names)
    found = 0
    for row in got:
        sid, sname, score = brute(row.name, stores)
        assert (row.matched_store_id, row.matched_store_name) == (sid, sname), row.name
        assert row.score == pytest.approx(score, abs=1e-12)
        found += sid is not None
    assert 0 < found < len(names)


def test_fuzzy_match_refuses_a_threshold_it_cannot_block(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(ValueError):
        fuzzy_match_stores(df, df, threshold=0.5)


def test_waybill_keys(spark):
    rows = [
        ("0964437553/5", None, {"0964437553/5", "0964437553"}),
        ("invoice_19_1", "0968 606515", {"0968606515"}),
        ("12345", None, set()),
        ("1234567/8", None, {"1234567/8"}),
        (None, None, set()),
    ]
    for number, found, want in rows:
        df = spark.createDataFrame([(number, found)], "n string, f string")
        got = df.select(matching.waybill_keys(F.col("n"), F.col("f"))).first()[0]
        assert set(got) == want


def test_parts_of_one_file_are_dealt_before_names_are_compared(spark, tmp_path):
    from tradewind.plans import catalog

    rows = [(i, f"large ring {i}", "Brand#7", "SMALL", 1, 9.0) for i in range(50)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.load_all()[0]["name_similarity"](spark, str(tmp_path))
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 50


def test_names_are_taken_apart_once_each_with_a_work_folder(spark, tmp_path):
    rng = random.Random(11)
    stores = list(enumerate(random_names(40, 5), start=1))
    names = [scan(s, rng) for _, s in stores * 3]
    # Every store comes again under larger ids, one of them without an id.
    copies = stores + [(i + 100, s) for i, s in stores] + [(None, "ხხხ")]
    args = (
        spark.createDataFrame([(n,) for n in [*names, "", "ხხხ"] * 3], "name string"),
        spark.createDataFrame(copies, "id long, name string"),
    )
    planned, kept = fuzzy_match_stores(*args), fuzzy_match_stores(*args, work=str(tmp_path))
    assert sorted(map(str, planned.collect())) == sorted(map(str, kept.collect()))
    by_name = {r.name: r for r in kept.collect()}
    assert by_name["ხხხ"].matched_store_id is None
    for name in {n for n in names if n}:
        assert (by_name[name].matched_store_id, by_name[name].matched_store_name) == brute(name, stores)[:2]
    folders = {p.name.rsplit("-", 1)[0]: spark.read.parquet(str(p)) for p in tmp_path.iterdir()}
    assert folders["wanted-names"].count() == len({*names, "ხხხ"} - {""})
    assert folders["known-stores"].count() == len({s for _, s in copies})
    # The inputs are not read again, so nothing runs on each of their rows.
    assert "LogicalRDD" not in kept._jdf.queryExecution().optimizedPlan().toString()
