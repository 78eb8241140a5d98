"""Frames stored by day: same rows, other days not read."""

import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from tradewind.operators.scope import filter_by_date_range, in_period, on_listed_days
from tradewind.sources.stored_days import PARTS, replace_days, store_by_day

DAY = PARTS["day"]
START, END = date(2026, 5, 2), date(2026, 5, 3)


@pytest.fixture
def invoices(spark):
    """Ten days, a third of all rows on one of them, some without a date."""
    n = F.col("id")
    day = F.when(n % 3 == 0, F.lit(date(2026, 5, 2))).when(
        n % 11 != 0, F.date_add(F.lit(date(2026, 5, 1)), (n % 10).cast("int"))
    )
    return spark.range(3000).select(
        n.alias("invoice_id"),
        day.alias("effective_date"),
        F.when(n % 2 == 0, "2026-05-03").alias("created_at_raw"),
    )


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _ids(df):
    return sorted(r.invoice_id for r in df.select("invoice_id").collect())


@pytest.mark.parametrize("grain, folders", [("day", {"2026-05-02", "2026-05-03"}), ("month", {"2026-05-01"})])
def test_periods_read_their_days_only(invoices, tmp_path, grain, folders):
    more = invoices.unionByName(
        invoices.withColumn("effective_date", F.add_months("effective_date", 1)).withColumn("invoice_id", -F.col("invoice_id"))
    )
    stored = store_by_day(more, f"{tmp_path}/t", "invoice_id", grain=grain, work=f"{tmp_path}/work")
    assert stored.columns == [*invoices.columns, PARTS[grain]]
    assert _ids(stored) == _ids(more)
    for keep in (lambda df: filter_by_date_range(df, "effective_date", START, END), lambda df: in_period(df, START, END)):
        assert _ids(keep(stored)) == _ids(keep(more)) != []
        assert PARTS[grain] in _plan(keep(stored)).split("PartitionFilters: [")[1].split("]")[0]
    read = filter_by_date_range(stored, "effective_date", START, END).select(F.input_file_name().alias("f")).distinct()
    assert {r.f.split(f"{PARTS[grain]}=")[1].split("/")[0] for r in read.collect()} == folders


def test_a_hot_day_is_several_files(spark, invoices, tmp_path):
    # Tasks as small as these would be put together.
    together = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, "false")
    try:
        store_by_day(invoices, f"{tmp_path}/t", "invoice_id")
    finally:
        spark.conf.set(together, "true")
    assert len(glob.glob(f"{tmp_path}/t/{DAY}=2026-05-02/*.parquet")) > 1


def test_listed_days_prune_by_join(spark, invoices, tmp_path):
    stored = store_by_day(invoices, f"{tmp_path}/t", "invoice_id")
    spark.range(20).select(F.date_add(F.lit(date(2026, 4, 25)), F.col("id").cast("int")).alias("day"), "id").write.parquet(
        f"{tmp_path}/days"
    )
    days = spark.read.parquet(f"{tmp_path}/days").filter("id % 7 = 0")
    got = on_listed_days(stored, days)
    assert got.columns == stored.columns
    assert _ids(got) == _ids(on_listed_days(invoices, days)) != []
    assert "dynamicpruning" in _plan(got)


def test_replaced_days_leave_the_others(spark, invoices, tmp_path):
    path = f"{tmp_path}/t"
    store_by_day(invoices, path, "invoice_id")
    before = set(glob.glob(f"{path}/*/*.parquet"))
    new = invoices.filter("effective_date = '2026-05-02'").limit(1)
    stored = replace_days(new, path, "invoice_id")
    after = set(glob.glob(f"{path}/*/*.parquet"))
    assert {f for f in before if "2026-05-02" not in f} == {f for f in after if "2026-05-02" not in f}
    assert stored.filter("effective_date = '2026-05-02'").count() == 1
    with pytest.raises(ValueError):
        store_by_day(stored, f"{tmp_path}/again", "invoice_id")


def test_empty_frame(invoices, tmp_path):
    stored = store_by_day(invoices.filter("false"), f"{tmp_path}/t", "invoice_id")
    assert in_period(stored, START, END).count() == 0
