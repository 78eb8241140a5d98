"""Numbers through a ledger, and work tables: the same results as plans without them."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tradewind.operators import ingest as I
from tradewind.operators import stitching as ST
from tradewind.operators.keys import assign_ids, hash_block, ledger_numbers, ledger_ranks, order_block
from tradewind.plans.driver_tables import import_lines, stitch_tables, table
from tradewind.session import kept_in_buckets

SF = "/root/testdata/sf0.001"


@pytest.fixture
def work(tmp_path):
    return str(tmp_path / "work")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ledger_ids_are_those_of_the_plan(spark, work, n):
    df = spark.range(n).select((F.col("id") * 7 % 1009).alias("k"), F.concat(F.lit("n"), "id").alias("name")).repartition(5)
    for blocks, order in (([order_block("k", 64)], ["k"]), ([hash_block("name")], ["name"])):
        want = sorted(map(tuple, assign_ids(df, blocks, order, F.lit(100)).collect()))
        got = sorted(map(tuple, assign_ids(df, blocks, order, F.lit(100), work=work).collect()))
        assert got == want and sorted(r[2] for r in got) == list(range(101, 101 + n))


def test_numbers_stay_when_read_again(spark, work):
    df = spark.range(5000).select(F.rand(1).alias("x"), "id")
    numbered = ledger_numbers(df, ["x"], work, "n")
    assert numbered.select("id", "n").exceptAll(numbered.select("id", "n")).count() == 0
    assert [r.id for r in numbered.orderBy("n").collect()] == [r.id for r in df.orderBy("x").collect()]


def test_ranks_of_a_hot_group(spark, work):
    rng = random.Random(2)
    rows = [(1 if i % 3 else rng.randint(2, 9), rng.random(), i) for i in range(3000)]
    got = ledger_ranks(spark.createDataFrame(rows, "g long, x double, i long").repartition(7), ["g"], ["x", "i"], work, "n")
    found = {r.i: r.n for r in got.collect()}
    for g in range(1, 10):
        assert [found[i] for _, _, i in sorted(r for r in rows if r[0] == g)] == list(range(1, sum(r[0] == g for r in rows) + 1))


def test_import_with_and_without_a_work_folder(spark, work):
    lines = import_lines(spark, SF)
    known = [
        table(spark, SF, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        table(spark, SF, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.format_string("%010d", "o_orderkey").alias("invoice_number")),
        table(spark, SF, "lineitem").select(F.col("l_orderkey").alias("id")),
    ]
    planned, written = I.import_waybills(lines, *known), I.import_waybills(lines, *known, work=work)
    for name in ("stores", "invoices", "items"):
        a, b = getattr(planned, name), getattr(written, name)
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(AttributeError):
        written.nothing  # noqa: B018


def test_stitching_with_and_without_a_work_folder(spark, work):
    tables = stitch_tables(spark, SF)
    planned, written = ST.stitch_appendices(*tables), ST.stitch_appendices(*tables, work=work)
    for name in ("stores", "invoices", "items", "links", "summary"):
        a, b = getattr(planned, name), getattr(written, name)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), name


def test_bucketed_tables_meet_without_a_shuffle(spark, work):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = kept_in_buckets(work, "a", spark.range(1000).select("id", (F.col("id") * 2).alias("x")), "id")
        b = kept_in_buckets(work, "b", spark.range(500).select("id", F.lit(1).alias("y")), "id")
        joined = a.join(b, "id").groupBy("id").agg(F.sum("x"))
        assert joined.count() == 500
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["import_items", "ingest_items", "stitch_items", "stitch_invoices"])
def test_plans_of_large_loads_stay_short(spark, name):
    assert exchanges(entry_point.queries()[name](spark, SF)) < 15
