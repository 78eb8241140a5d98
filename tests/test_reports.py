"""Reports on a hand-made shop: expected values are worked out in the comments."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tradewind.operators.scope import scope_frames, scope_star, store_focus, store_search, user_scope
from tradewind.plans import reports as R
from tradewind.plans.quality import data_warnings, parity_check
from tradewind.plans.session_report import session_report
from tradewind.sources.tables import load_frames, load_star

START, END = date(2026, 5, 1), date(2026, 5, 10)
STORES = [(1, "ლაქი", "თბილისი #1"), (2, "ლაქი", "თბილისი #2"), (3, "სმარტი", None)]
PRODUCTS = [(1, "პური"), (2, "1. პური"), (3, "ტორტი")]
INVOICES = [
    # id, number, store, date, subtotal, total, notes, raw, created
    (1, "A1", 1, "2026-05-01", None, 100.0, None, "", "2026-05-01"),
    (2, "CR-2", 1, "02.05.2026", None, 10.0, None, "", "2026-05-02"),
    (3, "A3", 2, "05/05/26", 40.0, None, None, "", "2026-05-03T10:00:00"),
    (4, "A4", 3, "", None, None, None, "საქონელი", "2026-05-03"),
    (5, "A5", 9, "2026-05-10", None, 5.0, None, "", "2026-05-10"),
    (6, "A6", 1, "2026-06-01", None, 999.0, None, "", "2026-05-05"),
]
ITEMS = [
    # id, invoice, product, line_no, description, quantity, price, total
    (1, 1, 1, 1, "x", 10.0, 8.0, 80.0),
    (2, 1, 2, 2, "x", 2.0, 10.0, 20.0),
    (3, 2, 1, 1, "x", 1.0, 8.0, 0.0),
    (4, 3, 3, 1, "x", -4.0, 10.0, 0.0),
    (5, 3, None, 2, "სხვა", 1.0, None, None),
    (6, 5, 1, 1, "x", 1.0, 5.0, 5.0),
    (7, 6, 1, 1, "x", 1.0, 999.0, 999.0),
    (8, 77, 1, 1, "x", 1.0, 999.0, 999.0),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(
            INVOICES,
            "id long, invoice_number string, store_id long, invoice_date string, subtotal double, "
            "total double, notes string, raw_text string, created_at string",
        ),
        spark.createDataFrame(
            ITEMS,
            "id long, invoice_id long, product_id long, line_no int, description string, "
            "quantity double, unit_price double, line_total double",
        ),
        spark.createDataFrame(STORES, "id long, name string, address string"),
        spark.createDataFrame(PRODUCTS, "id long, name string"),
    )


@pytest.fixture(scope="module")
def star(tables):
    return load_star(*tables)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


S1, S2 = "ლაქი (#1)", "ლაქი (#2)"
S3 = "სმარტი (მისამართი_ბაზაში_არაა) · ID: 3"
S9 = "(უცნობი მაღაზია) (მისამართი_ბაზაში_არაა) · ID: 9"


def test_kpis(star):
    # revenue 100 + 10 + 40 + 0 + 5; returns: invoice 2, implied 1 x 8
    got = R.kpi_bundle(star, START, END).first()
    assert tuple(got) == (155.0, 8.0, 5.16, 4)


def test_kpis_of_an_empty_period_are_zero(star):
    got = R.kpi_bundle(star, date(2020, 1, 1), date(2020, 1, 2)).first()
    assert tuple(got) == (0.0, 0.0, 0.0, 0)


def test_revenue_and_sales_by_store(star):
    assert rows(R.revenue_by_store(star, START, END), "store_name", "revenue_gel") == [
        (S1, 110.0), (S2, 40.0), (S9, 5.0), (S3, 0.0),
    ]
    # invoice 4 has no lines, so store 3 is absent; invoice 3: -4 x 10 with no total sells 40
    assert rows(R.returns_vs_sales_by_store(star, START, END), "store_name", "sales_gel", "returns_gel") == [
        (S1, 100.0, 8.0), (S2, 40.0, 0.0), (S9, 5.0, 0.0),
    ]


def test_daily_series(star):
    d = lambda n: date(2026, 5, n)
    assert rows(R.daily_revenue(star, START, END), "day", "revenue_gel") == [
        (d(1), 100.0), (d(2), 10.0), (d(3), 40.0), (d(10), 5.0),
    ]
    assert rows(R.daily_sales_returns(star, START, END), "day", "sales_gel", "returns_gel") == [
        (d(1), 100.0, 0.0), (d(2), 0.0, 8.0), (d(3), 40.0, 0.0), (d(10), 5.0, 0.0),
    ]


def test_store_share(star):
    got = {r.store_name: (r.share_pct, r.return_pct) for r in R.store_share(star, START, END).collect()}
    assert got == {S1: (70.97, 8.0), S2: (25.81, 0.0), S9: (3.23, 0.0), S3: (0.0, 0.0)}


def test_products(star):
    got = rows(R.top_products_by_quantity(star, START, END, 2), "product_label", "quantity", "sales_gel", "pct_of_sales")
    # all sales of the period: 80 + 20 + 5 = 105
    assert got == [(f"{S1} · პური", 11.0, 80.0, 76.19), (f"{S1} · 1. პური", 2.0, 20.0, 19.05)]
    # total quantity 10 + 2 + 1 - 4 + 1 + 1 = 11
    shares = {r.product_label: r.pct_of_total_qty for r in R.all_products_by_quantity_share(star, START, END).collect()}
    assert shares[f"{S1} · პური"] == 100.0 and shares[f"{S2} · ტორტი"] == -36.36
    assert shares[f"{S2} · სხვა"] == 9.09
    merged = rows(R.products_across_stores(R.all_products_by_quantity_share(star, START, END), 1), "product", "quantity", "sales_gel")
    # The name of an unknown store holds the separator itself, so its line stays apart.
    assert merged == [("პური", 13.0, 100.0)]


def test_metrics_bands_and_extremes(spark):
    df = spark.createDataFrame(
        [("a", 100.0, 5.0), ("b", 100.0, 40.0), ("c", 0.0, 3.0), ("a", 100.0, 5.0), ("d", 50.0, -1.0)],
        "store_name string, sales_gel double, returns_gel double",
    )
    m = R.store_metrics(df)
    assert rows(R.heat_classes(m), "store_name", "return_rate_pct", "heat") == [
        ("b", 40.0, "red"), ("a", 5.0, "green"), ("d", 0.0, "green"), ("c", None, "neutral"),
    ]
    assert tuple(R.best_worst_store(m).first()) == ("d", 0.0, "b", 40.0)
    assert rows(R.top_return_rates(m, 2), "store_name", "return_pct") == [("a", 5.0), ("b", 40.0)]
    assert rows(R.top_stores_by_sales(df, 3), "store_name")[-1] in [("a",), ("b",)]


def test_top_n_plus_other(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(1, 6)], "store_name string, revenue_gel double")
    assert rows(R.top_n_plus_other(df, 2, "other"), "store_name", "revenue_gel") == [
        ("s5", 5.0), ("s4", 4.0), ("other", 6.0),
    ]
    assert R.top_n_plus_other(df, 9, "other").count() == 5


def test_network_summary(star):
    got = R.network_summary(star, START, END).first()
    assert (got.total_sales_gel, got.total_returns_gel, got.return_rate_pct, got.risk_band) == (145.0, 8.0, 5.52, "low")
    assert (got.active_stores, got.top_product, got.top_quantity) == (4, f"{S1} · პური", 11.0)


def test_restock(star):
    got = R.restock_by_store(star, START, END).first()
    # 110 over 10 days
    assert (got.store_name, got.avg_daily_revenue_gel, got.recommended_restock_gel) == (S1, 11.0, 19.25)
    assert 70 <= got.confidence_pct <= 80


def test_invariants(star):
    kpi = R.kpi_bundle(star, START, END).first()
    by_store = R.returns_vs_sales_by_store(star, START, END).agg(F.sum("returns_gel"), F.sum("sales_gel")).first()
    by_day = R.daily_sales_returns(star, START, END).agg(F.sum("returns_gel"), F.sum("sales_gel")).first()
    assert by_store == by_day and by_store[0] == kpi.total_returns_gel
    revenue = R.revenue_by_store(star, START, END)
    assert R.top_n_plus_other(revenue, 1).agg(F.sum("revenue_gel")).first()[0] == kpi.total_revenue_gel
    assert tuple(R.period_counts(star, START, END).first()) == (5, 6)


def test_loaded_frames_agree_with_the_star(tables):
    inv, lines = load_frames(*tables)
    assert inv.count() == 6 and lines.count() == 7
    first = lines.filter("line_id = 3").first()
    assert (first.parent_invoice_is_return, first.store_name, first.product_label) == (True, S1, "პური")
    assert lines.filter("line_id = 5").first().product_label == "სხვა"
    assert inv.filter("invoice_id = 3").first().effective_date == date(2026, 5, 3)
    assert inv.filter("invoice_id = 5").first().store_display_name == S9


def test_optional_columns_are_carried_when_present(spark, tables):
    invoices, items, stores, products = tables
    inv, lines = load_frames(
        invoices.withColumn("is_credit", F.lit(1)).drop("notes"), items.withColumn("is_return", F.lit(0)), stores, products
    )
    assert "is_credit" in inv.columns and "notes" not in inv.columns and "is_return" in lines.columns


def test_scope(spark, star, tables):
    assert R.kpi_bundle(scope_star(star, [2]), START, END).first().total_revenue_gel == 40.0
    assert R.kpi_bundle(scope_star(star, []), START, END).first().n_stores == 0
    users = spark.createDataFrame([(1, "Boss", "manager"), (2, "ana", "distributor")], "id long, username string, role string")
    pairs = spark.createDataFrame([(2, 1), (2, 2)], "user_id long, store_id long")
    assert user_scope(users, pairs, " boss") is None
    assert sorted(r.store_id for r in user_scope(users, pairs, "ANA").collect()) == [1, 2]
    assert user_scope(users, pairs, "nobody").count() == 0
    inv, lines = load_frames(*tables)
    a, b = scope_frames(inv, lines.drop("store_id"), user_scope(users, pairs, "ana"))
    assert a.count() == 4 and b.count() == 6
    a, b = scope_frames(inv, lines, [3])
    assert a.count() == 1 and b.count() == 0


def test_focus_and_search(spark, tables):
    inv, _ = load_frames(*tables)
    assert {r.store_id for r in store_focus(inv, "როგორია ლაქი?").collect()} == {1, 2}
    assert {r.store_id for r in store_focus(inv, "ფილიალი #2").collect()} == {2}
    assert store_focus(inv, "ზოგადად").count() == 0
    stores = tables[2]
    assert store_search(stores, "#2").count() == 1 and store_search(stores, "").count() == 3


def test_session_report(star):
    report = session_report(star, START, END, "ფილიალი #2", [1, 2]).collect()
    value = {(r.section, r.rank, r.metric): (r.name, r.value) for r in report}
    assert value["kpi", 1, "total_revenue_gel"] == ("all", 150.0)
    assert value["revenue", 1, "revenue_gel"] == (S1, 110.0)
    assert value["focus_kpi", 1, "n_stores"] == ("all", 1.0)
    assert value["focus_restock", 1, "recommended_restock_gel"] == (S2, 7.0)


def test_warnings(spark, tables):
    invoices, items, stores, products = tables
    got = {r["check"]: r for r in data_warnings(load_star(*tables), START, END).collect()}
    assert got["sales_equal_returns"].n == 0 and got["no_returns_sample"].n == 0
    assert got["address_without_code"].n == 0
    # Text says credit but the invoice is not flagged when only the plain word is searched.
    star = load_star(invoices.filter("id <> 2"), items, stores.withColumn("address", F.lit("ქუჩა")), products)
    star = star._replace(
        invoices=star.invoices.withColumn("raw_text", F.lit("საკრედიტო"))
    )
    got = {r["check"]: r for r in data_warnings(star, START, END).collect()}
    assert got["credit_text_without_returns"].n == 4
    assert got["no_returns_sample"].n == 1
    assert (got["address_without_code"].n, got["address_without_code"].sample) == (1, "ქუჩა")


def test_parity(star):
    assert parity_check(star, star, START, END).count() == 0
    other = star._replace(invoices=star.invoices.filter("invoice_id <> 3").withColumn("extra", F.lit(1)))
    failed = {r.metric for r in parity_check(star, other, START, END).collect()}
    assert {"invoice_rows", "total_revenue_gel", "n_stores", "invoices_column:extra"} <= failed
    assert "line_rows" not in failed and "total_returns_gel" not in failed


def test_invoice_lists(tables):
    invoices, items, stores, _ = tables
    invoices = invoices.withColumn("source_file", F.lit("f"))
    top = R.largest_invoices(invoices, items, stores, ["%#1"], 2)
    assert rows(top, "id", "total", "items") == [(6, 999.0, 1), (1, 100.0, 2)]
    assert rows(R.return_candidates(invoices, items, stores), "id", "store_name", "items") == [(2, "ლაქი", 1)]
    bad = R.negative_lines(items.withColumn("line_total", -F.col("line_total")), invoices).first()
    assert (bad.n_negative, bad.sum_negative, bad.n_noted_invoices) == (5, -2103.0, 0)
    sample = R.returns_line_sample(load_star(*tables), START, END, 3)
    assert rows(sample, "invoice_id", "parent_invoice_is_return") == [(1, False), (1, False), (2, True)]


def test_report_and_parity_read_lines_once(spark, tables, tmp_path):
    names = ("invoices", "items", "stores", "products")
    for name, table in zip(names, tables):
        table.write.parquet(f"{tmp_path}/{name}")
    stored = load_star(*[spark.read.parquet(f"{tmp_path}/{name}") for name in names])

    def reads(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        relations = [line for line in plan if "Relation" in line]
        return [sum(column in line for line in relations) for column in ("line_total", "raw_text")]

    assert reads(session_report(stored, START, END, "ფილიალი #2", [1, 2])) == [1, 2]
    assert reads(parity_check(stored, stored, START, END)) == [2, 2]


def test_session_report_without_rows(star):
    report = session_report(star, date(2020, 1, 1), date(2020, 1, 2), "ფილიალი #2").collect()
    assert {(r.section, r.rank, r.name, r.metric, r.value) for r in report} == {
        (section, 1, "all", metric, 0.0)
        for section in ("kpi", "focus_kpi")
        for metric in ("total_revenue_gel", "total_returns_gel", "returns_pct", "n_stores")
    }
    plain = session_report(star, START, END).collect()
    assert {r.section for r in plain} == {"kpi", "revenue", "restock", "products"}


def test_parity_counts_lines_without_invoice(star):
    fewer = star._replace(lines=star.lines.filter("invoice_id <> 77"))
    got = [tuple(r) for r in parity_check(star, fewer, START, END).collect()]
    assert got == [("line_rows", 8.0, 7.0)]
