"""Order planning: visit frequency and product recommendations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import money, text
from ..functions.money import exact_sum, round_exact
from ..operators.scope import filter_by_date_range, scope_filter


def order_history(
    invoices: DataFrame,
    lines: DataFrame,
    as_of: date,
    days: int = 60,
    allowed: DataFrame | list[int] | None = None,
) -> DataFrame:
    """Sold quantities per store, product and visit day of the last ``days`` days.

    ``invoices`` carry ``is_return`` (the phrase rule of ``not_return_by_phrases``).
    Quantities are summed per store, product and day, which is all the planning needs;
    lines without a product id are told apart by their ``description``, where there is one.
    """
    recent = filter_by_date_range(invoices, "effective_date", as_of - timedelta(days=days), date.max - timedelta(days=1))
    sold = scope_filter(recent.filter(~F.col("is_return")), allowed)
    text = F.col("description") if "description" in lines.columns else F.lit(None).cast("string")
    return (
        lines.filter(F.col("quantity") > 0)
        .withColumn("description", F.when(F.col("product_id").isNull(), text))
        .join(sold.select("invoice_id", "store_id", "effective_date"), "invoice_id")
        .groupBy("store_id", "product_id", "description", F.to_date("effective_date").alias("visit_date"))
        .agg(
            exact_sum(F.col("quantity")).alias("quantity"),
            exact_sum(F.col("line_total")).alias("line_total"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


def visit_frequency(history: DataFrame) -> DataFrame:
    """Mean days between visits per store, 2.0 when there is no gap to measure."""
    visits = history.filter(F.col("visit_date").isNotNull()).select("store_id", "visit_date").distinct()
    last = F.lag("visit_date").over(W.partitionBy("store_id").orderBy("visit_date"))
    gaps = visits.withColumn("gap", F.date_diff("visit_date", last))
    stats = gaps.groupBy("store_id").agg(
        F.sum("gap").cast("double").alias("days"),
        F.count("gap").alias("n_gaps"),
        F.count(F.lit(1)).alias("n_visits"),
        F.min("visit_date").alias("first_visit"),
        F.max("visit_date").alias("last_visit"),
    )
    mean = F.col("days") / F.nullif("n_gaps", F.lit(0))
    freq = F.coalesce(round_exact(mean, 1), F.lit(V.VISIT_DEFAULT_DAYS))
    return stats.select(
        "store_id",
        freq.alias("visit_freq_days"),
        "n_visits",
        F.greatest(F.date_diff("last_visit", "first_visit") + 1, F.lit(1)).alias("n_days"),
    )


def _base_confidence(n_visits: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for at_least, pct in V.VISIT_CONFIDENCE:
        out = out.when(n_visits >= at_least, F.lit(pct))
    return out.otherwise(F.lit(V.VISIT_CONFIDENCE_DEFAULT))


def product_recommendations(history: DataFrame, products: DataFrame) -> DataFrame:
    """Recommended quantity and confidence per store and product name, largest quantity first.

    The name is the product's, else the description of the line.
    """
    named = history.join(products.select("product_id", "product_name"), "product_id", "left")
    per_day = (
        named.withColumn("product", F.coalesce("product_name", "description", F.lit("")))
        .filter(F.length("product") >= 2)
        .groupBy("store_id", "product", "visit_date")
        .agg(F.sum("quantity").alias("quantity"))
    )
    dated = F.when(F.col("visit_date").isNotNull(), F.col("quantity").cast("double"))
    per_product = per_day.groupBy("store_id", "product").agg(
        F.sum("quantity").cast("double").alias("total"),
        F.count(dated).alias("n_dates"),
        F.stddev_samp(dated).alias("sd"),
        F.avg(dated).alias("mean"),
    )
    joined = per_product.join(visit_frequency(history), "store_id")
    base = _base_confidence(F.col("n_visits"))
    # Streaming variance differs in the last bits between engines; settle it first.
    cv = F.round(F.col("sd") / (F.col("mean") + 0.001), 6)
    confidence = (
        F.when((F.col("n_dates") > 2) & (cv < V.CV_STEADY), F.least(base + 10, F.lit(90)))
        .when((F.col("n_dates") > 2) & (cv > V.CV_ERRATIC), F.greatest(base - 15, F.lit(40)))
        .otherwise(base)
    )
    need = F.col("total") / F.col("n_days") * F.col("visit_freq_days") * V.ORDER_BUFFER
    return joined.select(
        "store_id",
        "product",
        round_exact(F.col("total") / F.col("n_visits"), 1).alias("avg_per_visit"),
        F.greatest(F.rint(need), F.lit(1.0)).cast("long").alias("recommended_qty"),
        confidence.alias("confidence_pct"),
        money.confidence_band(confidence).alias("confidence_band"),
        text.shelf_life(F.col("product")).alias("shelf_life_days"),
        "n_visits",
        "visit_freq_days",
    ).orderBy("store_id", F.desc("recommended_qty"), "product")


def order_plan(history: DataFrame, products: DataFrame, stores: DataFrame, as_of: date) -> DataFrame:
    """Per listed store: visit frequency, next visit, pieces to bring, products per band."""
    recs = product_recommendations(history, products)
    band = F.col("confidence_band")
    totals = recs.groupBy("store_id").agg(
        F.sum("recommended_qty").alias("total_pieces"),
        F.count(F.lit(1)).alias("n_products"),
        F.count_if(band == "high").alias("n_high"),
        F.count_if(band == "medium").alias("n_medium"),
        F.count_if(band == "low").alias("n_low"),
    )
    freq = visit_frequency(history).select("store_id", "visit_freq_days")
    zero = F.lit(0)
    days = F.coalesce("visit_freq_days", F.lit(V.VISIT_DEFAULT_DAYS))
    return (
        stores.select("store_id", F.col("store_display_name").alias("store_name"))
        .join(freq, "store_id", "left")
        .join(totals, "store_id", "left")
        .select(
            "store_id",
            "store_name",
            days.alias("visit_freq_days"),
            F.date_add(F.lit(as_of), F.rint(days).cast("int")).alias("next_visit"),
            *[F.coalesce(c, zero).alias(c) for c in ("total_pieces", "n_products", "n_high", "n_medium", "n_low")],
        )
    )


def order_plan_summary(plan: DataFrame) -> DataFrame:
    """Listed stores and their mean visit frequency, 2.0 counted for stores without history."""
    return plan.agg(
        F.count(F.lit(1)).alias("n_stores"),
        round_exact(
            exact_sum(F.col("visit_freq_days")).cast("double") / F.count(F.lit(1)), 1
        ).alias("mean_visit_freq"),
    )
