"""Labelled documents for the classifiers, and which of them are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents


def hash_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``limit`` rows of labelled documents.

    ``usable`` is a condition on ``doc_id``. Ids are drawn by a hash of the id, so the sample
    is the same at every partitioning; texts follow by a join, and of the joined rows the first
    ``limit`` by the same hash stay, however often documents repeat. Labels other than 0 and 1
    and labels without an id are ignored; of contradicting labels of one document the larger
    counts; of repeated documents each row is used.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = documents(docs, "doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "label")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)
