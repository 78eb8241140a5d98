"""Data warnings and the parity check between two copies of the data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..functions.money import as_double, exact_sum, pct_or_zero, round_array, round_exact
from ..operators.scope import in_period, period_mask
from ..sources.tables import Star
from .reports import line_sums, name_stores, store_facts

#: What the sample columns show; counts are always whole.
SAMPLE_ADDRESSES = 15
SAMPLE_TEXT = 900
SAMPLE_ADDRESS_TEXT = 800


def _row(df: DataFrame, check: str, n: Column, sample: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), n.cast("long").alias("n"), sample.alias("sample"))


def data_warnings(
    star: Star, start: date, end: date, sample_text: int = SAMPLE_TEXT, sample_addresses: int = SAMPLE_ADDRESSES
) -> DataFrame:
    """One row per check: (check, n, sample); n = 0 when there is nothing to report."""
    totals = store_facts(star, start, end).agg(
        as_double(F.coalesce(F.sum("sales"), F.lit(0).cast("decimal(28,4)"))).alias("sales"),
        as_double(F.coalesce(F.sum("returns"), F.lit(0).cast("decimal(28,4)"))).alias("returns"),
    )
    sales, refunds = F.col("sales"), F.col("returns")
    equal = (
        (sales > 1e-9)
        & (refunds > 1e-9)
        & (F.abs(sales - refunds) <= F.greatest(F.lit(1e-6), 1e-9 * F.abs(sales)))
    )
    pair = F.concat_ws(" / ", sales.cast("string"), refunds.cast("string"))
    out = _row(totals, "sales_equal_returns", equal.cast("int"), F.when(equal, pair))

    if "raw_text" in star.invoices.columns:
        inv = in_period(star.invoices, start, end).filter(
            ~F.coalesce("parent_invoice_is_return", F.lit(False))
        )
        raw = F.coalesce("raw_text", F.lit(""))
        no_returns = totals.select((refunds <= 1e-9).alias("x")).scalar()
        credit = inv.filter(raw.contains(V.CREDIT_WORD)).agg(
            F.count(F.lit(1)).alias("n"), F.min("invoice_id").alias("first")
        )
        label = F.concat(F.lit("invoice_id="), F.col("first").cast("string"))
        out = out.unionByName(
            _row(
                credit,
                "credit_text_without_returns",
                F.when(no_returns, F.col("n")).otherwise(0),
                F.when(no_returns, label),
            )
        )
        long_text = F.length(raw) > 40
        sample = inv.agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((~long_text).alias("short"), "invoice_id", raw.alias("t"))).alias("s"),
        )
        shown = F.concat(
            F.lit("invoice_id="), F.col("s.invoice_id").cast("string"), F.lit(" "),
            F.substring("s.t", 1, sample_text),
        )
        out = out.unionByName(
            _row(
                sample,
                "no_returns_sample",
                F.when(no_returns & (F.col("n") > 0), 1).otherwise(0),
                F.when(no_returns, shown),
            )
        )
    if "store_address" in star.stores.columns:
        out = out.unionByName(addresses_without_code(star.stores, sample_addresses))
    return out


def addresses_without_code(
    stores: DataFrame, n: int = SAMPLE_ADDRESSES, shown: int = SAMPLE_ADDRESS_TEXT
) -> DataFrame:
    """Distinct addresses without a branch code: their number and the first n."""
    addr = text.normalize_address(F.col("store_address"))
    bad = (
        stores.select(addr.alias("addr"))
        .filter((F.col("addr") != "") & (F.col("addr") != V.MISSING_ADDRESS))
        .distinct()
        .filter(text.branch_code(F.col("addr")).isNull())
    )
    first = bad.select(F.substring("addr", 1, shown).alias("addr")).orderBy("addr").limit(n)
    sample = first.agg(F.array_join(F.sort_array(F.collect_list("addr")), " | ")).scalar()
    counted = bad.agg(F.count(F.lit(1)).alias("n"))
    return _row(counted, "address_without_code", F.col("n"), F.nullif(sample, F.lit("")))


# --- parity --------------------------------------------------------------

def _long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of metrics as (metric, value) rows."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return df.select(F.inline(F.array(*pairs)))


def _sum_if(condition: Column, col: str) -> Column:
    return F.sum(F.when(condition, F.coalesce(col, F.lit(0))).otherwise(0).cast("decimal(28,4)"))


PARITY_METRICS = (
    "invoice_rows",
    "line_rows",
    "total_revenue_gel",
    "total_returns_gel",
    "returns_pct",
    "n_stores",
    "revenue_by_store_sum",
    "returns_vs_sales_sales",
    "returns_vs_sales_returns",
)


def parity_metrics(star: Star, start: date, end: date) -> DataFrame:
    """Row counts, KPIs and report sums of one copy, as (metric, value) rows.

    One pass: invoices and lines are read once each. Lines are summed per invoice, then meet
    all invoices in a full join, so that lines without an invoice are counted as well; sums
    per store id get names afterwards.
    """
    has_invoice = F.col("n_invoices").isNotNull()
    counted = F.coalesce("in_scope", F.lit(False))
    dated = counted & F.col("effective_date").isNotNull()
    is_return = F.coalesce("parent_invoice_is_return", F.lit(False))
    invoices = star.invoices.select(
        "invoice_id",
        "store_id",
        "effective_date",
        "revenue_gel",
        "parent_invoice_is_return",
        period_mask(star.invoices, start, end).alias("in_scope"),
        F.lit(1).alias("n_invoices"),
    )
    joined = invoices.join(line_sums(star.lines), "invoice_id", "full")
    by_id = joined.groupBy("store_id").agg(
        F.count_if(has_invoice).alias("invoice_rows"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("line_rows"),
        F.count_if(counted).alias("n"),
        exact_sum(F.when(counted, F.col("revenue_gel"))).alias("revenue"),
        exact_sum(F.when(dated, F.col("revenue_gel"))).alias("dated_revenue"),
        _sum_if(counted & ~is_return, "sale_value").alias("sales"),
        _sum_if(counted & is_return, "credit_value").alias("returns"),
    )
    sums = ("invoice_rows", "line_rows", "n", "revenue", "dated_revenue", "sales", "returns")
    by_name = name_stores(by_id, star.stores).groupBy("store_name").agg(*[F.sum(c).alias(c) for c in sums])

    def rounded(col: str) -> Column:
        return as_double(exact_sum(round_array(as_double(F.col(col)), 2)))

    total = by_name.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("invoice_rows", "line_rows")],
        F.count_if(F.col("n") > 0).alias("n_stores"),
        F.coalesce(as_double(F.sum("revenue")), F.lit(0.0)).alias("all_revenue"),
        F.coalesce(as_double(F.sum("returns")), F.lit(0.0)).alias("all_returns"),
        rounded("dated_revenue").alias("revenue_by_store_sum"),
        rounded("sales").alias("returns_vs_sales_sales"),
        F.greatest(rounded("returns"), F.lit(0.0)).alias("returns_vs_sales_returns"),
    )
    revenue, returns = F.col("all_revenue"), F.col("all_returns")
    figures = total.withColumns(
        {
            "total_revenue_gel": round_exact(revenue, 2),
            "total_returns_gel": round_exact(returns, 2),
            "returns_pct": round_exact(pct_or_zero(returns, revenue), 2),
        }
    )
    return _long(figures, PARITY_METRICS)


COUNT_METRICS = ("invoice_rows", "line_rows", "n_stores")


def parity_check(left: Star, right: Star, start: date, end: date, tol: float = 0.01) -> DataFrame:
    """Failures only: (metric, left, right). Counts must be equal, sums within ``tol``.

    Columns that only one side has are reported as metrics ``<table>_column:<name>``.
    """
    a = parity_metrics(left, start, end).withColumnRenamed("value", "left")
    b = parity_metrics(right, start, end).withColumnRenamed("value", "right")
    allowed = F.when(F.col("metric").isin(*COUNT_METRICS), 0.0).otherwise(tol)
    out = a.join(b, "metric").filter(F.abs(F.col("left") - F.col("right")) > allowed)
    gaps = []
    for table in ("invoices", "lines"):
        mine, theirs = set(getattr(left, table).columns), set(getattr(right, table).columns)
        gaps += [(f"{table}_column:{c}", 1.0, 0.0) for c in sorted(mine - theirs)]
        gaps += [(f"{table}_column:{c}", 0.0, 1.0) for c in sorted(theirs - mine)]
    if gaps:
        spark = left.invoices.sparkSession
        out = out.unionByName(
            spark.createDataFrame(gaps, "metric string, left double, right double")
        )
    return out.select("metric", "left", "right")
