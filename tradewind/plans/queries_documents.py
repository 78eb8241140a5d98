"""Registered queries for field extraction from document text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text
from ..functions.unicode import nfc
from ..operators import documents as O
from .catalog import query
from .driver_tables import scattered_documents, table, waybill_documents
from .queries_loading import _DOCS


@query(
    "document_lines",
    """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
    c AS (SELECT doc_id, i, regexp_replace(trim(raw), '[ \\t]+', ' ', 'g') AS line FROM l)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS line_no, line FROM c WHERE line <> ''""",
)
def _(spark, sf):
    return O.document_lines(table(spark, sf, "documents"))


@query(
    "composed_texts",
    """SELECT doc_id, md5(nfc_normalize(text)) AS composed, length(nfc_normalize(text)) AS n_points,
      contains(text, 'é') OR contains(text, 'ü') OR contains(text, 'ñ') OR contains(text, 'è') AS marked FROM documents""",
)
def _(spark, sf):
    """Whole texts whose letters were written with combining marks, composed again."""
    apart = F.col("text")
    for letter in "éèêëáàâäíìîïóòôöúùûüñçÉÈÊÁÀÄÍÓÖÚÜÑÇ":
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    docs = table(spark, sf, "documents").select("doc_id", apart.alias("text"))
    return docs.select("doc_id", nfc(F.col("text")).alias("text")).select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("composed"),
        F.length("text").cast("long").alias("n_points"),
        F.col("text").rlike("[éüñè]").alias("marked"),
    )


@query(
    "text_quality",
    """WITH t AS (SELECT doc_id, text, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS INTEGER) AS n FROM documents)
    SELECT doc_id, n AS n_dense_chars, n < 48 OR contains(lower(text), '(cid:') AS needs_reextraction FROM t""",
)
def _(spark, sf):
    return O.text_quality(table(spark, sf, "documents"))


@query(
    "document_dates",
    """SELECT doc_id, CASE lang WHEN 'en' THEN (n_chars % 28 + 1) || '.' || (doc_id % 12 + 1) || '.2026'
      WHEN 'de' THEN printf('2025-%02d-%02d', doc_id % 12 + 1, n_chars % 28 + 1)
      ELSE nullif(regexp_extract(text, '\\b(\\d{1,2}[\\/\\.\\-]\\d{1,2}[\\/\\.\\-]\\d{2,4})\\b', 1), '') END AS invoice_date FROM documents""",
)
def _(spark, sf):
    """Dates under their label, in ISO form, or anywhere: the label wins, then the ISO form."""
    day, month = F.col("n_chars") % 28 + 1, F.col("doc_id") % 12 + 1
    iso = F.format_string("2025-%02d-%02d", month, day)
    labelled = F.concat(iso, F.lit(" თარიღი (დღე): "), day, F.lit("."), month, F.lit(".2026"))
    dated = F.when(F.col("lang") == "en", labelled).when(F.col("lang") == "de", F.concat(F.lit("1/2/03 "), iso))
    texts = table(spark, sf, "documents").withColumn("text", F.concat_ws("\n", dated, "text"))
    return O.extract_header_fields(texts).select("doc_id", "invoice_date")


@query(
    "extract_header_fields",
    f"WITH {_DOCS} SELECT doc_id, waybill_number, invoice_date, invoice_time FROM head",
)
def _(spark, sf):
    return O.extract_header_fields(waybill_documents(spark, sf)).select(
        "doc_id", "waybill_number", "invoice_date", "invoice_time"
    )


@query(
    "extract_line_items",
    f"WITH {_DOCS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, name, quantity, price FROM items",
)
def _(spark, sf):
    return O.extract_line_items(waybill_documents(spark, sf))


@query(
    "extract_bundled_items",
    f"WITH {_DOCS} SELECT i.doc_id, CAST(line_no AS INTEGER) AS line_no, name, quantity, price FROM items i JOIN src USING (doc_id) WHERE lang IN ('en', 'fr')",
)
def _(spark, sf):
    return O.extract_line_items(waybill_documents(spark, sf), "bundled")


@query(
    "extract_parties",
    f"""WITH {_DOCS} SELECT doc_id, store_name, origin_address, buyer_address,
      CASE WHEN lang = 'es' THEN origin_address ELSE buyer_address END AS branch_address FROM head""",
)
def _(spark, sf):
    return O.extract_parties(waybill_documents(spark, sf)).select(
        "doc_id", "store_name", "origin_address", "buyer_address", "branch_address"
    )


@query(
    "document_fallbacks",
    """SELECT doc_id,
      CASE doc_id % 6 WHEN 0 THEN 'შპს მაღაზია ' || source WHEN 1 THEN 'შპს სმარტ ' || source WHEN 2 THEN 'სს ბაზარი ' || source
        WHEN 3 THEN 'სს ზღაპარი ' || source WHEN 5 THEN 'შპს ორი ' || source END AS buyer_name,
      CASE doc_id % 6 WHEN 0 THEN 'ბათუმი #' || doc_id WHEN 1 THEN 'სენაკი, ქუჩა ' || doc_id WHEN 2 THEN 'თბილისი, სადღაც #' || doc_id
        WHEN 3 THEN 'თბილისი #' || doc_id WHEN 4 THEN 'ქუთაისი, ქუჩა 1 #' || doc_id END AS origin,
      CASE doc_id % 6 WHEN 0 THEN 'გორი, ქუჩა ' WHEN 1 THEN 'ფოთი, ქუჩა ' WHEN 2 THEN 'ზესტაფონი, ქუჩა ' WHEN 3 THEN 'ნაკვეთი '
        WHEN 4 THEN 'ქუთაისი, გამზირი ' ELSE 'თბილისი, ქუჩა ' END || n_chars
        || CASE WHEN doc_id % 6 IN (1, 5) THEN ' ბინა ' || doc_id ELSE '' END AS destination
    FROM documents""",
)
def _(spark, sf):
    """Pages whose names and addresses only the fallbacks find, every fallback by many pages."""
    lined = scattered_documents(spark, sf).withColumn("lines", D.clean_lines(F.col("text")))
    lines = F.col("lines")
    return lined.select(
        "doc_id",
        D.buyer_name(lines).alias("buyer_name"),
        D.origin_address(lines).alias("origin"),
        D.destination_address(F.col("text"), lines).alias("destination"),
    )


@query(
    "document_name_by_header",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'around' WHEN 1 THEN 'header' WHEN 2 THEN 'header' WHEN 3 THEN 'above'
      WHEN 5 THEN 'above' ELSE 'none' END AS found FROM documents""",
)
def _(spark, sf):
    """Which step of the cascade named the buyer: the line above, the window around, the header."""
    lined = scattered_documents(spark, sf).withColumn("lines", D.clean_lines(F.col("text")))
    lines = F.col("lines")
    return lined.select(
        "doc_id",
        F.when(text.blank_to_null(D.buyer_name_above_label(lines)).isNotNull(), "above")
        .when(D.buyer_name_near_label(lines).isNotNull(), "around")
        .when(D.buyer_name_in_header(lines).isNotNull(), "header")
        .otherwise("none")
        .alias("found"),
    )


@query(
    "document_regions",
    """SELECT doc_id, ' (მიმღების) დასახელება' || chr(10) || 'საიდენტიფიკაციო / პირადი ნომერი' || chr(10) || '400111222' || chr(10)
        || 'ქუთაისი, გამზირი ' || (n_chars % 28 + 1) || ' #' || doc_id || ' ტრანსპორტირების დაწყების ადგილი' || chr(10)
        || CASE WHEN lang = 'es' THEN 'უკან დაბრუნება' ELSE 'მიწოდება' END || chr(10)
        || 'ტრანსპორტირების დასრულების ადგილი: თბილისი, ქუჩა ' || source || ' #' || n_chars AS header,
      'საიდენტიფიკაციო / პირადი ნომერი' || chr(10) || '400111222' || chr(10) || 'ქუთაისი, გამზირი ' || (n_chars % 28 + 1) || ' #' || doc_id AS block,
      'თბილისი, ქუჩა ' || source || ' #' || n_chars AS addresses
    FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    return waybill_documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit(" "), D.header_region(text)).alias("header"),
        D.buyer_block(text).alias("block"),
        D.collect_addresses(D.header_region(text)).alias("addresses"),
    )
