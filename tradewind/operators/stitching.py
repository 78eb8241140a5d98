"""Linking appendix documents of unknown buyers to their main invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.documents import waybill_number
from ..functions.matching import waybill_keys
from ..functions.money import as_double
from ..session import kept_in, kept_in_buckets
from .keys import ledger_ranks, number_rows, order_block
from .results import Tables

NO_LINE = 999_999
LINE_BLOCK = 1 << 12


class Stitched(Tables):
    """Tables after the merge: stores, invoices, items; and links, summary."""


def invoice_keys(invoices: DataFrame) -> DataFrame:
    """(id, key) of every waybill key of an invoice, from its number and its raw text."""
    found = waybill_number(F.coalesce("raw_text", F.lit("")))
    keys = waybill_keys(F.col("invoice_number"), found)
    return invoices.select("id", F.explode(keys).alias("key"))


def find_parents(appendices: DataFrame, known: DataFrame) -> DataFrame:
    """(appendix_id, parent_id): the earliest known invoice that shares a key.

    Several keys may hit different invoices; the smallest id counts. Without a key
    match the earliest known invoice with exactly the same number is taken.
    """
    index = invoice_keys(known).groupBy("key").agg(F.min("id").alias("parent_id"))
    by_key = (
        invoice_keys(appendices)
        .join(index, "key")
        .groupBy(F.col("id").alias("appendix_id"))
        .agg(F.min("parent_id").alias("key_parent"))
    )
    by_number = known.groupBy("invoice_number").agg(F.min("id").alias("number_parent"))
    return (
        appendices.select(F.col("id").alias("appendix_id"), "invoice_number")
        .join(by_key, "appendix_id", "left")
        .join(by_number, "invoice_number", "left")
        .select("appendix_id", F.coalesce("key_parent", "number_parent").alias("parent_id"))
        .filter(F.col("parent_id").isNotNull())
    )


def _line_blocks(line: Column, row_id: Column) -> dict[str, Column]:
    """Blocks in the order (line, id): runs of line numbers, the unnumbered ones by id."""
    low = line - F.pmod(line, F.lit(LINE_BLOCK))
    high = F.lit(NO_LINE + 1) + ((line - NO_LINE - 1) - F.pmod(line - NO_LINE - 1, F.lit(LINE_BLOCK)))
    start = F.when(line < NO_LINE, low).when(line == NO_LINE, line).otherwise(high)
    return {
        "line_block": start,
        "id_block": F.when(line == NO_LINE, order_block(row_id)).otherwise(F.lit(0).cast("long")),
    }


def move_items(items: DataFrame, links: DataFrame, work: str | None = None) -> DataFrame:
    """Items of appendices under their parent, numbered after the parent's last line.

    With a ``work`` folder moved items are numbered through a ledger; items and links that are
    bucketed by invoice and appendix are not shuffled to meet.
    """
    # One join tells both parts apart, so items and links are shuffled once for them.
    linked = items.join(links.withColumnRenamed("appendix_id", "invoice_id"), "invoice_id", "left")
    moved = linked.filter(F.col("parent_id").isNotNull())
    line = F.coalesce(F.col("line_no").cast("long"), F.lit(NO_LINE))
    keyed = moved.withColumn("_line", line)
    if work is not None:
        moved_rows = kept_in(work, "moved-items", keyed)
        numbered = ledger_ranks(moved_rows, ["parent_id"], ["invoice_id", "_line", "id"], work, "_rank")
    else:
        numbered = number_rows(
            keyed,
            ["parent_id"],
            order_block("invoice_id"),
            {"appendix": F.col("invoice_id"), **_line_blocks(F.col("_line"), F.col("id"))},
            ["_line", "id"],
            "_rank",
        )
    last = items.groupBy(F.col("invoice_id").alias("parent_id")).agg(
        F.max(F.coalesce("line_no", F.lit(0))).alias("_last")
    )
    placed = (
        numbered.join(last, "parent_id", "left")
        .withColumn("line_no", (F.coalesce("_last", F.lit(0)) + F.col("_rank")).cast("int"))
        .withColumn("invoice_id", F.col("parent_id"))
        .select(*items.columns)
    )
    return linked.filter(F.col("parent_id").isNull()).select(*items.columns).unionByName(placed)


def _quoted(col: Column) -> Column:
    """A text in quotes, escaped the way the notes have always shown it."""
    body = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    plain = ~col.contains('"')
    return F.when(col.contains("'") & plain, double).otherwise(single)


def merged_notes(invoices: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """(parent_id, notes) for parents whose appendices have a file name or notes.

    Without a limit the notes are whole. With one, only as many parts are gathered as fit
    below it, however many appendices a parent has.
    """
    blank = F.lit("")
    source = F.when(
        F.coalesce("source_file", blank) != "",
        F.concat(F.lit("merged appendix source_file="), _quoted(F.col("source_file"))),
    )
    note = F.when(F.coalesce("notes", blank) != "", F.concat(F.lit("appendix notes: "), "notes"))
    parts = (
        links.join(invoices.select(F.col("id").alias("appendix_id"), "source_file", "notes"), "appendix_id")
        .select("parent_id", "appendix_id", F.concat_ws(" | ", source, note).alias("part"))
        .filter(F.col("part") != "")
    )
    if limit is not None:
        # A part takes at least one character and the separator of three: later ones can't fit.
        ranked = number_rows(
            parts, ["parent_id"], order_block("appendix_id"), {"a": order_block("appendix_id", 1 << 10)},
            ["appendix_id"], "rank",
        ).filter(F.col("rank") <= limit // 4 + 1)
        before = W.partitionBy("parent_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        parts = ranked.withColumn(
            "start", F.coalesce(F.sum(F.length("part") + 3).over(before), F.lit(0))
        ).filter(F.col("start") < limit)
    joined = parts.groupBy("parent_id").agg(
        F.sort_array(F.collect_list(F.struct("appendix_id", "part"))).alias("parts")
    )
    own = invoices.select(F.col("id").alias("parent_id"), F.nullif("notes", blank).alias("own"))
    extra = F.array_join(F.transform("parts", lambda p: p["part"]), " | ")
    notes = F.concat_ws(" | ", "own", extra)
    cut = notes if limit is None else F.substring(notes, 1, limit)
    return joined.join(own, "parent_id").select("parent_id", cut.alias("notes"))


def recompute_totals(invoices: DataFrame, items: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Subtotal and total from the items, NULL when no item has a value.

    ``touched`` (a column ``id``) limits the update to some invoices.
    """
    sums = items.groupBy(F.col("invoice_id").alias("id")).agg(
        F.sum(F.col("line_total").cast("decimal(18,4)")).alias("_sum")
    )
    fresh = as_double(F.round("_sum", 4))
    if touched is None:
        out = invoices.join(sums, "id", "left").withColumns({"subtotal": fresh, "total": fresh})
    else:
        marked = touched.select("id").distinct().withColumn("_touched", F.lit(True))
        joined = invoices.join(sums, "id", "left").join(marked, "id", "left")
        hit = F.col("_touched").isNotNull()
        out = joined.withColumns(
            {c: F.when(hit, fresh).otherwise(F.col(c)) for c in ("subtotal", "total")}
        )
    return out.select(*invoices.columns)


def store_invoice_counts(stores: DataFrame, invoices: DataFrame) -> DataFrame:
    """All stores with their number of invoices, by name ignoring case."""
    counts = invoices.groupBy(F.col("store_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        stores.select("id", "name")
        .join(counts, "id", "left")
        .select("id", "name", F.coalesce("n", F.lit(0)).alias("n_invoices"))
        .orderBy(F.lower("name"), "id")
    )


def stitch_appendices(
    stores: DataFrame,
    invoices: DataFrame,
    items: DataFrame,
    placeholder: str = V.UNKNOWN_BUYER,
    notes_limit: int | None = None,
    work: str | None = None,
) -> Stitched:
    """Merge appendices of the placeholder store into their parent invoices.

    Every part reads the links. With a ``work`` folder links, headers and items are written
    there, bucketed by invoice, so that each is shuffled once however many parts read it.
    """
    is_placeholder = F.trim("name") == placeholder
    unknown = stores.filter(is_placeholder).select(F.col("id").alias("store_id"))
    real = stores.filter(~is_placeholder).select(F.col("id").alias("store_id"))
    invoices = kept_in_buckets(work, "headers", invoices, "id")
    appendices = invoices.join(unknown, "store_id", "left_semi")
    known = invoices.join(real, "store_id", "left_semi")
    links = kept_in_buckets(work, "appendix_links", find_parents(appendices, known), "appendix_id")
    kept = invoices.join(links.select(F.col("appendix_id").alias("id")), "id", "left_anti")
    orphan = unknown.join(kept.select("store_id"), "store_id", "left_anti")

    def new_items() -> DataFrame:
        dealt = kept_in_buckets(work, "items", items, "invoice_id")
        return kept_in_buckets(work, "stitched_items", move_items(dealt, links, work), "invoice_id")

    def new_invoices() -> DataFrame:
        notes = merged_notes(invoices, links, notes_limit).withColumnRenamed("parent_id", "id")
        noted = (
            kept.join(notes.withColumnRenamed("notes", "_notes"), "id", "left")
            .withColumn("notes", F.coalesce("_notes", "notes"))
            .select(*invoices.columns)
        )
        return recompute_totals(noted, stitched.items, links.select(F.col("parent_id").alias("id")))

    def summary() -> DataFrame:
        one = F.count(F.lit(1))
        merged = links.agg(one).scalar()
        return appendices.agg(one.alias("seen")).select(
            "seen",
            merged.alias("stitched"),
            (F.col("seen") - merged).alias("skipped"),
            orphan.agg(one).scalar().alias("orphan_stores_deleted"),
            (F.col("seen") - merged).alias("remaining_unknown"),
        )

    stitched = Stitched(
        stores=lambda: stores.join(orphan.select(F.col("store_id").alias("id")), "id", "left_anti").select(*stores.columns),
        invoices=new_invoices,
        items=new_items,
        links=lambda: links,
        summary=summary,
    )
    return stitched


def skipped_appendices(
    invoices: DataFrame, stores: DataFrame, links: DataFrame, placeholder: str = V.UNKNOWN_BUYER
) -> DataFrame:
    """Appendices without a parent, with up to three of their keys."""
    unknown = stores.filter(F.trim("name") == placeholder).select(F.col("id").alias("store_id"))
    left = invoices.join(unknown, "store_id", "left_semi").join(
        links.select(F.col("appendix_id").alias("id")), "id", "left_anti"
    )
    keys = waybill_keys(F.col("invoice_number"), waybill_number(F.coalesce("raw_text", F.lit(""))))
    return left.select(
        "id", "invoice_number", F.array_join(F.slice(F.sort_array(keys), 1, 3), ", ").alias("keys")
    )
