"""Plans and skew: what has to hold when the tables are large."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tradewind.operators import ingest as I
from tradewind.operators.keys import assign_ids, hash_block, number_rows, order_block
from tradewind.plans import catalog
from tradewind.plans import reports as R
from tradewind.plans.driver_tables import END, START, star
from tradewind.sources.tables import Star

SF = "/root/testdata/sf0.001"
# The stream runs while the query is built; it is covered by its own tests.
QUERIES = sorted(set(catalog.load_all()[0]) - {"waybill_stream"})


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_pairs_rows_without_a_key_or_runs_python(spark):
    """No cartesian product, nested-loop join or Python worker in any registered query."""
    for name in QUERIES:
        plan = entry_point.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert node not in plan, (name, node)


def test_lines_are_summed_before_they_are_shuffled(spark):
    plan = R.returns_vs_sales_by_store(star(spark, SF), START, END)._jdf.queryExecution().sparkPlan().toString()
    lines = plan[plan.index("FileScan parquet") :]
    assert "partial_sum" in plan
    assert "l_tax" not in lines and "l_comment" not in lines


def test_period_filter_and_columns_reach_the_scan(spark):
    plan = R.daily_revenue(star(spark, SF), START, END)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_share_report_reuses_its_shuffles(spark):
    plan = final_plan(R.top_products_by_quantity(star(spark, SF), START, END))
    assert "ReusedExchange" in plan or "ReusedSubquery" in plan


def hot_star(spark, n=20_000):
    """A third of all lines on one invoice, a third of all invoices in one store."""
    invoices = spark.range(n).select(
        F.col("id").alias("invoice_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).cast("long").alias("store_id"),
        F.lit(date(2026, 5, 1)).alias("effective_date"),
        F.lit(1.0).alias("revenue_gel"),
        (F.col("id") % 7 == 0).alias("parent_invoice_is_return"),
    )
    lines = spark.range(3 * n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % n).cast("long").alias("invoice_id"),
        (F.col("id") % 11).alias("product_id"),
        F.lit(2.0).alias("quantity"),
        F.lit(0.1).alias("unit_price"),
        F.lit(0.2).alias("line_total"),
    )
    stores = spark.range(50).select(F.col("id").alias("store_id"), F.concat(F.lit("s"), "id").alias("store_display_name"))
    products = spark.range(11).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"))
    return Star(invoices, lines, stores, products)


def test_hot_invoice_and_hot_store_keep_results_whole(spark):
    s = hot_star(spark)
    day = date(2026, 5, 1)
    kpi = R.kpi_bundle(s, day, day).first()
    assert kpi.total_revenue_gel == 20_000.0 and kpi.n_stores == 50
    sums = R.returns_vs_sales_by_store(s, day, day).agg(F.sum("sales_gel"), F.sum("returns_gel")).first()
    assert round(sum(sums), 2) == 12_000.0
    assert R.all_products_by_quantity_share(s, day, day).agg(F.sum("quantity")).first()[0] == 120_000.0
    # After the first sum the hot invoice is one row like any other.
    assert R.line_sums(s.lines).filter("invoice_id = 1").count() == 1


def test_hot_key_upsert_is_an_aggregate(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("invoice_id"),
        F.lit("p").alias("product_name"),
        F.lit("b").alias("buyer_barcode"),
        F.col("id").cast("double").alias("quantity"),
        F.col("id").alias("line_no"),
    )
    latest = I.latest_per_key(df)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
    assert latest.count() == 20_001
    assert latest.filter("invoice_id = 'hot'").first().quantity == 29_997.0


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_ids_are_dense_and_ordered(spark, size):
    df = spark.range(1000).select((F.col("id") * 3).alias("k")).repartition(5)
    got = assign_ids(df, [order_block("k", size)], ["k"], F.lit(100)).orderBy("k").collect()
    assert [r.id for r in got] == list(range(101, 1101))
    names = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("name"))
    ids = [r.id for r in assign_ids(names, [hash_block("name")], ["name"], F.lit(0)).collect()]
    assert sorted(ids) == list(range(1, 1001))


def test_rows_are_numbered_within_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 9).alias("g"), "id")
    got = number_rows(df, ["g"], order_block("id", 1000), {"b": order_block("id", 64)}, ["id"], "n").collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.id):
        groups.setdefault(r.g, []).append(r.n)
    assert len(got) == 5000
    assert all(ns == list(range(1, len(ns) + 1)) for ns in groups.values())
