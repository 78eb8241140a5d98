"""The scoped bundle of figures for one user and one question."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates, money, text
from ..functions.money import as_double, exact_sum, round_array, round_exact
from ..operators.scope import in_period, named_in, scope_star
from ..sources.tables import Star
from .reports import SEP

FOCUS = "focus_"
#: Rows per section, without and with focus.
LIMITS = {"kpi": 1, "restock": 8, "products": 8, "revenue": 8}
FOCUS_LIMITS = {"kpi": 1, "restock": 3, "products": 5}

# Of a section's measures: ``a`` and ``b`` are revenue and returns of a store, or quantity and
# sales of a product; ``dated`` is revenue of dated invoices; ``n`` and ``n_dated`` count rows.
MEASURES = ("a", "b", "dated", "n", "n_dated")


def _store_facts(invoices: DataFrame) -> DataFrame:
    """Header sums per store id; reads no line."""
    revenue, is_dated = F.col("revenue_gel"), F.col("is_dated")
    return invoices.groupBy("store_id").agg(
        exact_sum(revenue).alias("revenue"),
        exact_sum(F.when(is_dated, revenue)).alias("dated_revenue"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_dated).alias("n_dated"),
    )


def _line_facts(star: Star, invoices: DataFrame) -> DataFrame:
    """Line sums per store and product, of which returns count for stores."""
    is_return, is_dated = F.col("is_return"), F.col("is_dated")
    _, credit = money.line_values(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    quantity = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    sale = F.greatest(F.coalesce(F.col("line_total").cast("double"), F.lit(0.0)), F.lit(0.0))
    has_text = "description" in star.lines.columns
    free_text = F.col("description") if has_text else F.lit(None).cast("string")
    by_id = (
        star.lines.join(invoices.select("invoice_id", "store_id", "is_return", "is_dated"), "invoice_id")
        .groupBy("store_id", "product_id", free_text.alias("description"))
        .agg(
            exact_sum(F.when(is_dated, quantity)).alias("quantity"),
            exact_sum(F.when(is_dated, sale)).alias("sales"),
            exact_sum(F.when(is_return, credit)).alias("returns"),
            exact_sum(F.when(is_return & is_dated, credit)).alias("dated_returns"),
            F.count_if(is_dated).alias("n_dated"),
        )
    )
    product = F.coalesce("product_name", "description", F.lit(""))
    return by_id.join(star.products, "product_id", "left").select(
        "store_id", product.alias("product"), "quantity", "sales", "returns", "dated_returns", "n_dated"
    )


def _measure(section: str, key: Column, **values: Column) -> Column:
    """One measured row; what is not named is 0."""
    count, zero = F.lit(0).cast("long"), F.lit(0).cast("decimal(28,4)")
    none = {"n": count, "n_dated": count}
    return F.struct(
        F.lit(section).alias("section"),
        key.alias("key"),
        *[values.get(m, none.get(m, zero)).alias(m) for m in MEASURES],
    )


def _in_blocks(df: DataFrame, stores: DataFrame, prompt: str) -> DataFrame:
    """Rows with their store's name, once per block they count in."""
    names = stores.select("store_id", F.col("store_display_name").alias("store_name"))
    # Focus goes by the name, so stores of one name are in it together.
    flagged = names.withColumn("is_focus", named_in(F.col("store_name"), prompt))
    named = df.join(flagged, "store_id", "left").withColumn(
        "store_name", F.coalesce("store_name", text.unknown_store_name(F.col("store_id")))
    )
    blocks = F.when(F.col("is_focus"), F.array(F.lit(""), F.lit(FOCUS))).otherwise(F.array(F.lit("")))
    return named.withColumn("block", F.explode(blocks))


def _measured(star: Star, invoices: DataFrame, prompt: str) -> DataFrame:
    """(block, section, key) and measures: stores, stores with repaired names, products."""
    in_focus, name = F.col("block") == FOCUS, F.col("store_name")
    dated, n_dated = F.col("dated_revenue"), F.col("n_dated")

    def of_block(whole: str, focus: str) -> Column:
        return F.when(in_focus, F.col(focus)).otherwise(F.col(whole))

    headers = [
        _measure("store", name, a=of_block("revenue", "dated_revenue"), dated=dated, n=of_block("n", "n_dated"), n_dated=n_dated),
        _measure("restock", text.fix_store_name_typos(name), dated=dated, n_dated=n_dated),
    ]
    products = [
        _measure("store", name, b=of_block("returns", "dated_returns")),
        _measure(
            "products", F.concat("store_name", F.lit(SEP), "product"),
            a=F.col("quantity"), b=F.col("sales"), n_dated=n_dated,
        ),
    ]
    by_store = _in_blocks(_store_facts(invoices), star.stores, prompt)
    by_line = _in_blocks(_line_facts(star, invoices), star.stores, prompt)
    rows = by_store.select("block", F.inline(F.array(*headers))).unionByName(
        by_line.select("block", F.inline(F.array(*products)))
    )
    return rows.groupBy("block", "section", "key").agg(*[F.sum(m).alias(m) for m in MEASURES])


def _sections(measured: DataFrame, blocks: list[str]) -> DataFrame:
    """Store rows become the revenue list and, summed, the key figures; the rest stays."""
    a, b, dated, n, n_dated = (F.col(m) for m in MEASURES)
    kpi = F.struct(
        F.lit("kpi").alias("section"), F.lit("all").alias("key"), a.alias("a"), b.alias("b"),
        dated.alias("dated"), (n > 0).cast("long").alias("n"),
    )
    own = F.struct(
        F.when(F.col("section") == "store", "revenue").otherwise(F.col("section")).alias("section"),
        F.col("key"), a.alias("a"), b.alias("b"), dated.alias("dated"), n.alias("n"),
    )
    of_store = F.col("section") == "store"
    listed = n_dated > 0
    parts = F.when(of_store & listed & (F.col("block") == ""), F.array(kpi, own)).when(
        of_store, F.array(kpi)
    ).when(listed, F.array(own))
    zero = F.lit(0).cast("decimal(38,4)")
    # Key figures exist without any invoice.
    seed = measured.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in blocks])).alias("block"), F.lit("kpi").alias("section"),
        F.lit("all").alias("key"), zero.alias("a"), zero.alias("b"), zero.alias("dated"), F.lit(0).cast("long").alias("n"),
    )
    return (
        measured.select("block", F.inline(parts))
        .unionByName(seed)
        .groupBy("block", "section", "key")
        .agg(*[F.sum(m).alias(m) for m in ("a", "b", "dated", "n")])
    )


def _figures(section: Column, start: date, end: date) -> tuple[Column, Column]:
    """(metrics of a row, the value it is ranked by)."""
    revenue, returns = as_double(F.col("a")), as_double(F.col("b"))
    dated = as_double(F.col("dated"))
    daily = round_array(dated / dates.period_days(start, end), 2)
    stock = round_array(daily * V.RESTOCK_COVER, 2)

    def metrics(**values: Column) -> Column:
        return F.array(
            *[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
        )

    lists = (
        F.when(
            section == "kpi",
            metrics(
                total_revenue_gel=round_exact(revenue, 2),
                total_returns_gel=round_exact(returns, 2),
                returns_pct=round_exact(money.pct_or_zero(returns, revenue), 2),
                n_stores=F.col("n"),
            ),
        )
        .when(
            section == "restock",
            metrics(
                recommended_restock_gel=stock,
                avg_daily_revenue_gel=daily,
                confidence_pct=money.confidence_hash(F.col("key"), start, end),
            ),
        )
        .when(section == "products", metrics(quantity=round_array(revenue, 2), sales_gel=round_array(returns, 2)))
        .otherwise(metrics(revenue_gel=round_array(dated, 2)))
    )
    ranked_by = (
        F.when(section == "restock", stock).when(section == "products", revenue).otherwise(round_array(dated, 2))
    )
    return lists, ranked_by


def session_report(
    star: Star,
    start: date,
    end: date,
    prompt: str = "",
    allowed: DataFrame | Iterable[int] | None = None,
) -> DataFrame:
    """KPIs, top stores, restock and products of a user's scope, as one long frame.

    When the prompt names stores, a focus block on them is added; it counts dated invoices
    only. The scope is applied before anything is summed.

    All sections come from one pass: lines are read, and joined to their invoices, once.
    Invoices are read once for that join and once for header sums, which need no shuffle of
    rows: joining lines to invoices from the invoices' side, so that one read would do, keeps
    adaptive execution from splitting a hot invoice. Each section keeps its first rows per
    task before they meet, so that no section is ranked whole.
    """
    scoped = scope_star(star, allowed)
    invoices = in_period(scoped.invoices, start, end).select(
        "invoice_id",
        "store_id",
        "revenue_gel",
        F.coalesce("parent_invoice_is_return", F.lit(False)).alias("is_return"),
        F.col("effective_date").isNotNull().alias("is_dated"),
    )
    blocks = ["", FOCUS] if prompt else [""]
    rows = _sections(_measured(scoped, invoices, prompt), blocks)
    metrics, ranked_by = _figures(F.col("section"), start, end)
    of_section = W.partitionBy("block", "section").orderBy(F.desc("ranked_by"), F.desc("exact"), "key")
    exact = F.when(F.col("section") == "products", F.col("a"))
    top = (
        rows.withColumns({"ranked_by": ranked_by, "exact": exact, "metrics": metrics})
        .withColumn("rank", F.row_number().over(of_section))
        .filter(F.col("rank") <= max(*LIMITS.values(), *FOCUS_LIMITS.values()))
    )
    limit = F.lit(0)
    for prefix, limits in (("", LIMITS), (FOCUS, FOCUS_LIMITS)):
        for section, n in limits.items():
            limit = F.when((F.col("block") == prefix) & (F.col("section") == section), n).otherwise(limit)
    return top.filter(F.col("rank") <= limit).select(
        F.concat("block", "section").alias("section"), "rank", F.col("key").alias("name"), F.inline("metrics")
    )
