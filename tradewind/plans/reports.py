"""Dashboard reports over a star of facts and dimensions.

Lines are summed per invoice before they meet their invoice, and facts are
summed per store or product id before names are joined. The wide fact tables
are shuffled once, on the invoice id, and names never travel with facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates, money, text
from ..functions.money import as_double, exact_sum, round_array
from ..functions.returns import return_candidate
from ..operators.scope import filter_by_date_range, in_period
from ..sources.tables import Star

SEP = " · "


def line_sums(lines: DataFrame) -> DataFrame:
    """Per invoice: value of its lines if it is a sale, and if it is a return."""
    sale, credit = money.line_values(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    return lines.groupBy("invoice_id").agg(
        exact_sum(sale).alias("sale_value"),
        exact_sum(credit).alias("credit_value"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def name_stores(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Replace store_id by the display name; unmatched ids get the placeholder name."""
    unknown = text.unknown_store_name(F.col("store_id"))
    names = stores.select("store_id", F.col("store_display_name").alias("store_name"))
    joined = df.join(names, "store_id", "left")
    return joined.withColumn("store_name", F.coalesce("store_name", unknown)).drop("store_id")


def invoice_values(star: Star, start: date, end: date) -> DataFrame:
    """Invoices of the period with the sales and returns of their lines."""
    inv = in_period(star.invoices, start, end).select(
        "invoice_id",
        "store_id",
        "effective_date",
        "revenue_gel",
        F.coalesce("parent_invoice_is_return", F.lit(False)).alias("is_return"),
    )
    zero = F.lit(0).cast("decimal(28,4)")
    return inv.join(line_sums(star.lines), "invoice_id", "left").select(
        "store_id",
        "effective_date",
        F.when(F.col("effective_date").isNotNull(), F.col("revenue_gel")).alias("dated_revenue"),
        "revenue_gel",
        F.when(~F.col("is_return"), F.coalesce("sale_value", zero)).otherwise(zero).alias("sales"),
        F.when(F.col("is_return"), F.coalesce("credit_value", zero)).otherwise(zero).alias("returns"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
    )


def store_facts(star: Star, start: date, end: date) -> DataFrame:
    """Per display name: revenue, sales, returns (exact decimals) and counts."""
    sums = {
        "revenue": exact_sum(F.col("revenue_gel")),
        "dated_revenue": exact_sum(F.col("dated_revenue")),
        "sales": F.sum("sales"),
        "returns": F.sum("returns"),
        "n_lines": F.sum("n_lines"),
        "n_invoices": F.count(F.lit(1)),
        "n_dated": F.count("effective_date"),
    }
    by_id = invoice_values(star, start, end).groupBy("store_id").agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    return name_stores(by_id, star.stores).groupBy("store_name").agg(
        *[F.sum(n).alias(n) for n in sums]
    )


def revenue_facts(star: Star, start: date, end: date) -> DataFrame:
    """Per display name: header revenue of dated invoices, without touching the lines."""
    inv = filter_by_date_range(star.invoices, "effective_date", start, end)
    by_id = inv.groupBy("store_id").agg(exact_sum(F.col("revenue_gel")).alias("revenue"))
    return name_stores(by_id, star.stores).groupBy("store_name").agg(
        F.sum("revenue").alias("revenue")
    )


def _money(col: str | Column) -> Column:
    return round_array(as_double(F.col(col) if isinstance(col, str) else col), 2)


def kpi_bundle(star: Star, start: date, end: date) -> DataFrame:
    """One row: revenue (return invoices included), returns, their share, store count."""
    total = store_facts(star, start, end).agg(
        F.coalesce(as_double(F.sum("revenue")), F.lit(0.0)).alias("revenue"),
        F.coalesce(as_double(F.sum("returns")), F.lit(0.0)).alias("returns"),
        F.count("store_name").alias("n_stores"),
    )
    return total.select(
        money.round_exact(F.col("revenue"), 2).alias("total_revenue_gel"),
        money.round_exact(F.col("returns"), 2).alias("total_returns_gel"),
        money.round_exact(money.pct_or_zero(F.col("returns"), F.col("revenue")), 2).alias("returns_pct"),
        "n_stores",
    )


def revenue_by_store(star: Star, start: date, end: date) -> DataFrame:
    return (
        revenue_facts(star, start, end)
        .select("store_name", _money("revenue").alias("revenue_gel"))
        .orderBy(F.desc("revenue_gel"), "store_name")
    )


def _sales_returns(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("n_lines") > 0).select(
        "store_name",
        _money("sales").alias("sales_gel"),
        F.greatest(_money("returns"), F.lit(0.0)).alias("returns_gel"),
    )


def returns_vs_sales_by_store(star: Star, start: date, end: date) -> DataFrame:
    return _sales_returns(store_facts(star, start, end)).orderBy(F.desc("sales_gel"), "store_name")


def daily_revenue(star: Star, start: date, end: date) -> DataFrame:
    inv = filter_by_date_range(star.invoices, "effective_date", start, end)
    return (
        inv.groupBy(F.to_date("effective_date").alias("day"))
        .agg(_money(exact_sum(F.col("revenue_gel"))).alias("revenue_gel"))
        .orderBy("day")
    )


def daily_sales_returns(star: Star, start: date, end: date) -> DataFrame:
    values = invoice_values(star, start, end)
    dated = values.filter(F.col("effective_date").isNotNull() & (F.col("n_lines") > 0))
    return (
        dated.groupBy(F.to_date("effective_date").alias("day"))
        .agg(
            _money(F.sum("sales")).alias("sales_gel"),
            F.greatest(_money(F.sum("returns")), F.lit(0.0)).alias("returns_gel"),
        )
        .orderBy("day")
    )


def store_share(star: Star, start: date, end: date) -> DataFrame:
    """Revenue share and return rate per store with dated revenue."""
    base = (
        store_facts(star, start, end)
        .filter(F.col("n_dated") > 0)
        .select(
            "store_name",
            _money("dated_revenue").alias("revenue_gel"),
            _money("sales").alias("sales_gel"),
            F.greatest(_money("returns"), F.lit(0.0)).alias("returns_gel"),
        )
    )
    # The total needs invoice headers only, not the lines.
    revenue = revenue_facts(star, start, end).select(_money("revenue").alias("revenue_gel"))
    total = as_double(revenue.agg(exact_sum(F.col("revenue_gel"))).scalar())
    rate = F.when(F.col("sales_gel") == 0, F.lit(0.0)).otherwise(
        F.col("returns_gel") / F.nullif("sales_gel", F.lit(0.0)) * 100.0
    )
    return base.withColumns(
        {
            "share_pct": round_array(money.share_pct(F.col("revenue_gel"), total), 2),
            "return_pct": round_array(rate, 2),
        }
    ).orderBy(F.desc("revenue_gel"), "store_name")


def restock_by_store(star: Star, start: date, end: date) -> DataFrame:
    """Average daily revenue, recommended stock value and a stable confidence."""
    days = dates.period_days(start, end)
    named = revenue_facts(star, start, end).withColumn(
        "store_name", text.fix_store_name_typos(F.col("store_name"))
    )
    sums = named.groupBy("store_name").agg(as_double(F.sum("revenue")).alias("revenue_gel"))
    daily = sums.withColumn("avg_daily_revenue_gel", round_array(F.col("revenue_gel") / days, 2))
    return daily.withColumns(
        {
            "recommended_restock_gel": round_array(
                F.col("avg_daily_revenue_gel") * V.RESTOCK_COVER, 2
            ),
            "confidence_pct": money.confidence_hash(F.col("store_name"), start, end),
        }
    ).orderBy(F.desc("recommended_restock_gel"), "store_name")


def store_metrics(sales_returns: DataFrame) -> DataFrame:
    """Return rate per store, NULL without sales, highest first."""
    name = "store_name" if "store_name" in sales_returns.columns else "store_display_name"
    sums = sales_returns.groupBy(F.col(name).alias("store_name")).agg(
        as_double(exact_sum(F.col("sales_gel"))).alias("sales"),
        F.greatest(as_double(exact_sum(F.col("returns_gel"))), F.lit(0.0)).alias("returns"),
    )
    return sums.select(
        "store_name",
        round_array(F.col("sales"), 2).alias("sales_gel"),
        round_array(F.col("returns"), 2).alias("returns_gel"),
        round_array(money.pct_or_null(F.col("returns"), F.col("sales")), 2).alias("return_rate_pct"),
    ).orderBy(F.desc_nulls_last("return_rate_pct"), "store_name")


def heat_classes(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("heat", money.heat_class(F.col("return_rate_pct")))


# --- products ------------------------------------------------------------

def product_facts(star: Star, start: date, end: date) -> DataFrame:
    """Per ``store · product`` label: quantity and positive sales, exact."""
    inv = filter_by_date_range(star.invoices, "effective_date", start, end)
    q = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    sale = F.coalesce(F.greatest(F.col("line_total").cast("double"), F.lit(0.0)), F.lit(0.0))
    has_text = "description" in star.lines.columns
    free_text = F.col("description") if has_text else F.lit(None).cast("string")
    by_id = (
        star.lines.join(inv.select("invoice_id", "store_id"), "invoice_id")
        .groupBy("store_id", "product_id", free_text.alias("description"))
        .agg(exact_sum(q).alias("quantity"), exact_sum(sale).alias("sales"))
    )
    labelled = name_stores(by_id.join(star.products, "product_id", "left"), star.stores)
    product = F.coalesce("product_name", "description", F.lit(""))
    return labelled.groupBy(
        F.concat("store_name", F.lit(SEP), product).alias("product_label")
    ).agg(F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales"))


def product_totals(facts: DataFrame) -> Column:
    """Grand totals as a scalar subquery.

    It reads the same columns as the report, so Spark reuses the report's shuffles
    instead of joining the lines a second time.
    """
    return facts.agg(
        F.struct(F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales"))
    ).scalar()


def top_products_by_quantity(star: Star, start: date, end: date, n: int = 15) -> DataFrame:
    """Top labels by quantity; the share is of the sales of all labels."""
    facts = product_facts(star, start, end)
    total = product_totals(facts)["sales"]
    return (
        facts.withColumn("share", money.share_pct(F.col("sales"), total))
        .orderBy(F.desc("quantity"), "product_label")
        .limit(n)
        .select(
            "product_label",
            _money("quantity").alias("quantity"),
            _money("sales").alias("sales_gel"),
            round_array(F.col("share"), 2).alias("pct_of_sales"),
        )
    )


def all_products_by_quantity_share(star: Star, start: date, end: date) -> DataFrame:
    facts = product_facts(star, start, end)
    total = product_totals(facts)["quantity"]
    return facts.select(
        "product_label",
        _money("quantity").alias("quantity"),
        _money("sales").alias("sales_gel"),
        round_array(money.share_pct(F.col("quantity"), total), 2).alias("pct_of_total_qty"),
    ).orderBy(F.desc("quantity"), "product_label")


def products_across_stores(products: DataFrame, n: int = 15) -> DataFrame:
    """Labels without their store prefix and row numbers, regrouped, top n by quantity."""
    return (
        products.groupBy(text.product_from_label(F.col("product_label")).alias("product"))
        .agg(
            as_double(exact_sum(F.col("quantity"))).alias("quantity"),
            as_double(exact_sum(F.col("sales_gel"))).alias("sales_gel"),
        )
        .orderBy(F.desc("quantity"), "product")
        .limit(n)
        .orderBy("quantity", F.desc("product"))
    )


# --- summaries and chart data --------------------------------------------

def network_summary(star: Star, start: date, end: date) -> DataFrame:
    """One row: line sales and returns, rate and risk band, active stores, top product."""
    facts = store_facts(star, start, end)
    with_lines = F.col("n_lines") > 0
    sales = as_double(exact_sum(F.when(with_lines, _money("sales"))))
    refunds = as_double(exact_sum(F.when(with_lines, _money("returns"))))
    total = facts.agg(
        sales.alias("total_sales_gel"),
        refunds.alias("total_returns_gel"),
        F.count("store_name").alias("active_stores"),
    )
    top = (
        top_products_by_quantity(star, start, end, 1)
        .agg(F.first(F.struct("product_label", "quantity")).alias("top"))
        .scalar()
    )
    rate = F.when(
        F.col("total_sales_gel") > 1e-9,
        F.col("total_returns_gel") / F.nullif("total_sales_gel", F.lit(0.0)) * 100.0,
    ).otherwise(0.0)
    return total.select(
        "total_sales_gel",
        "total_returns_gel",
        round_array(rate, 2).alias("return_rate_pct"),
        money.risk_band(rate).alias("risk_band"),
        "active_stores",
        top["product_label"].alias("top_product"),
        top["quantity"].alias("top_quantity"),
    )


def best_worst_store(metrics: DataFrame) -> DataFrame:
    """Lowest and highest return rate among stores with sales; ties by name."""
    rated = metrics.filter(F.col("sales_gel") > 1e-6)
    pick = F.struct("return_rate_pct", "store_name")
    rev = F.struct((-F.col("return_rate_pct")).alias("r"), F.col("store_name"))
    return rated.agg(F.min(pick).alias("best"), F.min(rev).alias("worst")).select(
        F.col("best.store_name").alias("best_store"),
        F.col("best.return_rate_pct").alias("best_rate_pct"),
        F.col("worst.store_name").alias("worst_store"),
        (-F.col("worst.r")).alias("worst_rate_pct"),
    )


def top_n_plus_other(revenue: DataFrame, n: int = 10, other: str = V.OTHER_STORES) -> DataFrame:
    """Top n stores by revenue and one row with the rest, when there is any."""
    top = revenue.orderBy(F.desc("revenue_gel"), "store_name").limit(n)
    # At most n rows: safe to broadcast.
    rest = (
        revenue.join(F.broadcast(top.select("store_name")), "store_name", "left_anti")
        .agg(as_double(exact_sum(F.col("revenue_gel"))).alias("revenue_gel"))
        .filter(F.col("revenue_gel") > 0)
        .select(F.lit(other).alias("store_name"), "revenue_gel")
    )
    return top.select("store_name", "revenue_gel").unionByName(rest)


def top_stores_by_sales(sales_returns: DataFrame, n: int = 15) -> DataFrame:
    """Top n by sales, shown ascending; NULL counts as 0, returns never below 0."""
    top = sales_returns.orderBy(F.desc_nulls_last("sales_gel"), "store_name").limit(n)
    return top.select(
        "store_name",
        F.coalesce("sales_gel", F.lit(0.0)).alias("sales_gel"),
        F.greatest(F.coalesce("returns_gel", F.lit(0.0)), F.lit(0.0)).alias("returns_gel"),
    ).orderBy("sales_gel", F.desc("store_name"))


def top_return_rates(rates: DataFrame, n: int = 20) -> DataFrame:
    """Top n by absolute rate, shown ascending; stores without a rate left out."""
    name = "return_pct" if "return_pct" in rates.columns else "return_rate_pct"
    return (
        rates.filter(F.col(name).isNotNull())
        .select("store_name", F.col(name).alias("return_pct"))
        .orderBy(F.desc(F.abs("return_pct")), "store_name")
        .limit(n)
        .orderBy("return_pct", F.desc("store_name"))
    )


def period_counts(star: Star, start: date, end: date) -> DataFrame:
    """Number of invoices in the period and of their lines."""
    inv = filter_by_date_range(star.invoices, "effective_date", start, end)
    per_invoice = star.lines.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n"))
    joined = inv.select("invoice_id").join(per_invoice, "invoice_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_invoices"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
    )


def returns_line_sample(star: Star, start: date, end: date, n: int = 25) -> DataFrame:
    """The first n lines of the period with their return flag, in a fixed order."""
    inv = in_period(star.invoices, start, end).select(
        "invoice_id", "store_id", "parent_invoice_is_return"
    )
    order = ["invoice_id", "product_id", "quantity", "unit_price", "line_total"]
    top = star.lines.join(inv, "invoice_id").orderBy(*order).limit(n)
    named = name_stores(top, star.stores).join(star.products, "product_id", "left")
    return named.select(
        "invoice_id",
        "store_name",
        F.col("store_name").alias("unique_store_key"),
        "quantity",
        "unit_price",
        "line_total",
        F.coalesce("product_name", F.lit("")).alias("product_label"),
        F.coalesce("parent_invoice_is_return", F.lit(False)).alias("parent_invoice_is_return"),
    )


def _count_items(top: DataFrame, items: DataFrame) -> DataFrame:
    """Item count of a top-n frame of invoices; n keys are safe to broadcast."""
    keys = F.broadcast(top.select(F.col("id").alias("invoice_id")))
    counts = (
        items.join(keys, "invoice_id", "left_semi")
        .groupBy("invoice_id")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    joined = top.join(counts, F.col("id") == F.col("invoice_id"), "left").drop("invoice_id")
    return joined.withColumn("items", F.coalesce("items", F.lit(0)))


def largest_invoices(
    invoices: DataFrame, items: DataFrame, stores: DataFrame, patterns: Sequence[str], n: int = 10
) -> DataFrame:
    """Top n invoices by total of stores whose address matches a LIKE pattern, with item count."""
    hit = reduce(lambda a, b: a | b, [F.col("address").ilike(p) for p in patterns])
    mine = stores.filter(hit).select(F.col("id").alias("store_id"))
    top = (
        invoices.join(mine, "store_id", "left_semi")
        .orderBy(F.desc_nulls_last("total"), "id")
        .limit(n)
        .select("id", "invoice_number", "source_file", "total")
    )
    return _count_items(top, items)


def return_candidates(
    invoices: DataFrame, items: DataFrame, stores: DataFrame, n: int = 20
) -> DataFrame:
    """Top n invoices by total that look like returns, with store and item count."""
    names = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    top = (
        invoices.filter(return_candidate(F.col("notes"), F.col("invoice_number")))
        .join(names, "store_id")
        .orderBy(F.desc_nulls_last("total"), "id")
        .limit(n)
        .select("id", "invoice_number", "notes", "total", "store_name")
    )
    return _count_items(top, items)


def negative_lines(items: DataFrame, invoices: DataFrame, word: str = V.RETURN_NOTE_WORD) -> DataFrame:
    """Count and sum of negative lines; count of invoices whose notes contain a word."""
    bad = items.filter(F.col("line_total") < 0).agg(
        F.count(F.lit(1)).alias("n_negative"),
        as_double(F.sum(F.col("line_total").cast("decimal(18,4)"))).alias("sum_negative"),
    )
    noted = invoices.filter(F.col("notes").ilike(f"%{word}%")).agg(F.count(F.lit(1)))
    return bad.withColumn("n_noted_invoices", noted.scalar())
