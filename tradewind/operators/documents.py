"""Extraction jobs over a table of document texts (doc_id, file, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, documents as D, text as T


def extract_header_fields(docs: DataFrame) -> DataFrame:
    """Waybill number, date and time of every document."""
    dated = docs.withColumns(
        {
            "waybill_number": D.waybill_number(F.col("text")),
            "invoice_date": dates.extract_document_date(F.col("text")),
        }
    )
    return dated.withColumn(
        "invoice_time", dates.extract_document_time(F.col("text"), F.col("invoice_date"))
    )


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): non-empty cleaned lines, numbered from 1."""
    lines = docs.select("doc_id", F.posexplode(D.clean_lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def extract_line_items(docs: DataFrame, kind: str = "best") -> DataFrame:
    """(doc_id, line_no, name, quantity, price) of bundled, plain or the better kind of lines."""
    pick = {"bundled": D.bundled_items, "plain": D.plain_items, "best": D.line_items}[kind]
    rows = docs.select("doc_id", F.posexplode(pick(F.col("text"))).alias("pos", "item"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), "item.*")


def extract_parties(docs: DataFrame) -> DataFrame:
    """Buyer name (raw and cleaned), destination, origin and branch address."""
    lined = docs.withColumn("lines", D.clean_lines(F.col("text")))
    lines = F.col("lines")
    raw = lined.withColumns(
        {
            "store_name_raw": D.buyer_name(lines),
            "origin_raw": D.origin_address(lines),
            "destination_raw": D.destination_address(F.col("text"), lines),
        }
    )
    destination = F.col("destination_raw")
    branch = D.store_branch_address(F.col("text"), F.col("origin_raw"), destination)
    return raw.withColumns(
        {
            "store_name": T.clean_store_name(F.col("store_name_raw")),
            "origin_address": T.fix_address_ocr(F.col("origin_raw")),
            "buyer_address": T.fix_address_ocr(D.buyer_address(F.col("text"), destination)),
            "branch_address": T.fix_address_ocr(branch),
        }
    ).drop("lines", "origin_raw", "destination_raw")


def text_quality(docs: DataFrame) -> DataFrame:
    """Documents whose text is too thin or broken and must be extracted again."""
    dense = F.length(T.sub(F.coalesce("text", F.lit("")), r"\s+", ""))
    return docs.select(
        "doc_id",
        dense.alias("n_dense_chars"),
        D.needs_reextraction(F.col("text")).alias("needs_reextraction"),
    )


def extract_documents(docs: DataFrame) -> DataFrame:
    """Everything ``ingest_documents`` needs, one row per document, no shuffle."""
    full = extract_parties(extract_header_fields(docs))
    return full.withColumns(
        {
            "lines": D.line_items(F.col("text")),
            "raw_text": F.col("text"),
            "warnings": F.when(
                F.col("store_name").isNull(), F.array(F.lit("store_name unresolved"))
            ).otherwise(F.array().cast("array<string>")),
        }
    )
