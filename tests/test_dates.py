from datetime import date, datetime

from pyspark.sql import functions as F

from tradewind.functions import dates
from tradewind.operators.scope import filter_by_date_range, in_period

D = date(2026, 5, 14)


def test_parse_date_token(evaluate):
    cases = {
        "2026-05-14": D,
        "5/5/2026": date(2026, 5, 5),
        "31.03.2026": date(2026, 3, 31),
        "2026/3/1": date(2026, 3, 1),
        "01-02-2026": date(2026, 2, 1),
        "31/03/2026, x": date(2026, 3, 31),
        "2026-05-14T11:22:00": D,
        "05/05/26": None,
        "": None,
        None: None,
        "31/02/2026": None,
        "  14.05.2026 ": D,
        "5/5/2026, x": None,
        "05/5/2026 x": date(2026, 5, 5),
        "2026-05": None,
        "2026": None,
        "0000-01-01": None,
        "1/2-2026": None,
        "2024-02-29": date(2024, 2, 29),
        "2026-02-29": None,
    }
    assert evaluate(dates.parse_date_token, list(cases)) == list(cases.values())


def test_parse_created_at(evaluate):
    cases = {
        "2026-05-14T11:22:00Z": D,
        "2026-05-14 11:22:00": D,
        "2026-05-14": D,
        "20260514": D,
        "20260514T101112": D,
        "14.05.2026 10:00": D,
        "soon": None,
        None: None,
    }
    assert evaluate(dates.parse_created_at, list(cases)) == list(cases.values())


def test_effective_date_falls_back_to_creation(spark):
    df = spark.createDataFrame(
        [("05/05/26", "2026-05-14T01:00:00"), ("1/1/2026", "2026-05-14")], "a string, b string"
    )
    got = [r.d for r in df.select(dates.effective_date(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [D, date(2026, 1, 1)]


def test_presets_and_ranges():
    assert dates.preset_range("7 Days", D) == (date(2026, 5, 8), D)
    assert dates.preset_range("1 წელი", D) == (date(2025, 5, 15), D)
    assert dates.preset_range("no such label", D) == (date(2026, 4, 15), D)
    assert dates.period_days(D, D) == 1
    assert dates.period_days(D, date(2026, 5, 1)) == 1
    active = (date(2026, 1, 1), date(2026, 1, 31))
    assert dates.custom_range(D, date(2026, 5, 1), active) == active
    assert dates.custom_range(date(2026, 5, 1), D, active) == (date(2026, 5, 1), D)


def test_period_mask_uses_creation_date_only_without_effective_date(spark):
    rows = [
        (1, date(2026, 5, 1), "2026-01-01"),
        (2, None, "2026-05-02"),
        (3, None, "2026-06-02"),
        (4, date(2026, 6, 1), "2026-05-02"),
        (5, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, effective_date date, created_at_raw string")
    kept = {r.id for r in in_period(df, date(2026, 5, 1), date(2026, 5, 31)).collect()}
    assert kept == {1, 2}


def test_date_filter_includes_the_whole_last_day_and_tolerates_a_missing_column(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 5, 14, 23, 59),), (datetime(2026, 5, 15),), (None,)], "ts timestamp"
    )
    assert filter_by_date_range(df, "ts", D, D).count() == 1
    assert filter_by_date_range(df, "other", D, D).count() == 3


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(datetime(2026, 5, 14),)], "ts timestamp").write.parquet(path)
    df = filter_by_date_range(spark.read.parquet(path), "ts", D, D)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_document_date_and_time(spark):
    texts = [
        "თარიღი: 14/05/26 და 2026-01-01",
        "x 2026-05-14 y 1/1/2025",
        "შეკვეთა 1.2.2025",
        "no date",
    ]
    times = [
        "09:00:00 თარიღი: 14.05.2026 დრო (სთ): 10:20:30",
        "2026-05-14 " + "x" * 100 + " 11:22:33",
        "12:00:00 " + "x" * 400 + " 2026-05-14 სასაქონლო ზედნადების ცხრილი 13:00:00",
        "სასაქონლო ზედნადების ცხრილი 13:00:00",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r.d for r in df.select(dates.extract_document_date(F.col("t")).alias("d")).collect()]
    assert got == ["14/05/26", "2026-05-14", "1.2.2025", None]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t string").orderBy("i")
    date_token = dates.extract_document_date(F.col("t"))
    got = [r.d for r in df.select(dates.extract_document_time(F.col("t"), date_token).alias("d")).collect()]
    assert got == ["10:20:30", "11:22:33", "12:00:00", None]
