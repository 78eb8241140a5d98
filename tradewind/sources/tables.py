"""Stored tables and the enriched invoice and line frames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates, money, returns, text

INVOICE_OPTIONAL = ("is_return", "is_credit", "credit_note", "invoice_type", "document_type", "kind")
ITEM_OPTIONAL = ("is_return", "is_credit")
META = (
    "invoice_id",
    "effective_date",
    "store_id",
    "store_name",
    "store_display_name",
    "parent_invoice_is_return",
)


class Star(NamedTuple):
    """Facts and dimensions kept apart, so reports join names after aggregating.

    invoices: invoice_id, store_id, effective_date, revenue_gel,
        parent_invoice_is_return (created_at_raw, raw_text optional)
    lines: invoice_id, product_id, quantity, unit_price, line_total (description optional)
    stores: store_id, store_display_name
    products: product_id, product_name
    """

    invoices: DataFrame
    lines: DataFrame
    stores: DataFrame
    products: DataFrame


def optional_columns(df: DataFrame, names: Sequence[str], prefix: str = "") -> list[Column]:
    """Columns of ``names`` that the input has."""
    have = set(df.columns)
    return [F.col(prefix + n).alias(n) for n in names if n in have]


def enrich_stores(stores: DataFrame) -> DataFrame:
    """Name repair, branch code and display name, once per store rather than per invoice."""
    address = F.col("address") if "address" in stores.columns else F.lit(None).cast("string")
    base = stores.select(
        F.col("id").alias("store_id"),
        text.fix_store_name_typos(F.trim(F.coalesce("name", F.lit("")))).alias("store_name"),
        F.trim(F.coalesce(F.nullif(F.trim(address), F.lit("")), F.lit(V.MISSING_ADDRESS))).alias(
            "store_address"
        ),
    )
    name = text.strip(F.col("store_name"))
    coded = base.withColumn(
        "chain_store_name", F.when(name == "", F.lit(V.UNKNOWN_STORE)).otherwise(name)
    ).withColumn(
        "store_branch_id",
        F.coalesce(text.branch_code(F.col("store_address")), text.branch_code(F.col("store_name"))),
    )
    return coded.withColumn(
        "store_display_name",
        text.store_display_name(
            F.col("chain_store_name"),
            F.col("store_branch_id"),
            F.col("store_address"),
            F.col("store_id"),
        ),
    )


def _with_unknown_store(invoices: DataFrame) -> DataFrame:
    """Names for invoices whose store does not exist."""
    return invoices.withColumns(
        {
            "store_address": F.coalesce("store_address", F.lit(V.MISSING_ADDRESS)),
            "chain_store_name": F.coalesce("chain_store_name", F.lit(V.UNKNOWN_STORE)),
            "store_display_name": F.coalesce("store_display_name", text.unknown_store_name(F.col("store_id"))),
        }
    )


def _invoice_facts(invoices: DataFrame) -> DataFrame:
    have = set(invoices.columns)
    cols = [
        F.col("id").alias("invoice_id"),
        F.col("store_id"),
        F.col("invoice_date").alias("invoice_date_raw"),
        F.col("subtotal").alias("invoice_subtotal"),
        F.col("total").alias("invoice_total"),
        F.col("created_at").alias("created_at_raw"),
        *optional_columns(invoices, ("invoice_number", "source_file", "notes")),
    ]
    if "raw_text" in have:
        cols.append(F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    base = invoices.select(*cols, *optional_columns(invoices, INVOICE_OPTIONAL))

    def known(name: str) -> Column | None:
        return F.col(name) if name in base.columns else None

    return base.withColumns(
        {
            "effective_date": dates.effective_date(F.col("invoice_date_raw"), F.col("created_at_raw")),
            "revenue_gel": money.revenue_gel(F.col("invoice_total"), F.col("invoice_subtotal")),
            "parent_invoice_is_return": returns.is_return_document(
                known("invoice_number"), known("notes"), known("raw_text")
            ),
        }
    )


def load_invoices(invoices: DataFrame, stores: DataFrame) -> DataFrame:
    """Invoices with parsed date, revenue, return flag and store names.

    The flag reads the whole raw text; the text itself is dropped unless a query selects it.
    """
    joined = _invoice_facts(invoices).join(enrich_stores(stores), "store_id", "left")
    out = _with_unknown_store(joined)
    return out.withColumn("store_name", F.col("store_display_name")).withColumn(
        "unique_store_key", F.col("store_display_name")
    )


def load_line_items(items: DataFrame, products: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines of existing invoices with product name, else description, else ''."""
    return _lines_of(items, products, invoices.select(F.col("id").alias("invoice_key")))


def _lines_of(items: DataFrame, products: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines with the columns of their invoice (key ``invoice_key``), joined once."""
    extra = optional_columns(items, ITEM_OPTIONAL, "ii.")
    carried = [c for c in invoices.columns if c != "invoice_key"]
    return (
        items.alias("ii")
        .join(invoices, F.col("ii.invoice_id") == F.col("invoice_key"))
        .join(
            products.select(F.col("id").alias("product_key"), F.col("name").alias("product_name")),
            F.col("ii.product_id") == F.col("product_key"),
            "left",
        )
        .select(
            F.col("ii.id").alias("line_id"),
            F.col("ii.invoice_id").alias("invoice_id"),
            F.col("ii.product_id").alias("product_id"),
            F.coalesce(F.col("product_name"), F.col("ii.description"), F.lit("")).alias("product_label"),
            F.col("ii.quantity").alias("quantity"),
            F.col("ii.unit_price").alias("unit_price"),
            F.col("ii.line_total").alias("line_total"),
            *extra,
            *carried,
        )
    )


def load_frames(
    invoices: DataFrame, items: DataFrame, stores: DataFrame, products: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(invoices, lines): the enriched invoices, and lines with their invoice's meta data."""
    inv = load_invoices(invoices, stores)
    meta = inv.select(*META).withColumnRenamed("invoice_id", "invoice_key")
    lines = _lines_of(items, products, meta)
    flag = F.coalesce("parent_invoice_is_return", F.lit(False))
    return inv, lines.withColumn("parent_invoice_is_return", flag)


def load_star(
    invoices: DataFrame, items: DataFrame, stores: DataFrame, products: DataFrame
) -> Star:
    """The same data without joins, for the reports."""
    return Star(
        invoices=_invoice_facts(invoices),
        lines=items.select(
            "invoice_id", "product_id", "description", "quantity", "unit_price", "line_total",
            *optional_columns(items, ITEM_OPTIONAL),
        ),
        stores=enrich_stores(stores),
        products=products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")),
    )
