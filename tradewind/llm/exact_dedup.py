"""Exact deduplication by deterministic block naming.

The normalised text is cut into fixed-size blocks. The distinct blocks of the corpus are
sorted and numbered: their integer names. Adjacent names are paired, the distinct pairs
sorted and numbered again, and so on until one name is left per document. Two documents
have the same (level, name) exactly if their texts are equal: names stand for sorted
distinct contents, never for hash values.

Block contents move through one shuffle only, that of the distinct. Each occurrence looks
its name up by a 128-bit routing key; after naming, the job checks that no two contents
share a routing key and widens the keys otherwise, so that routing can't merge contents.

Defined results: null text is empty text; empty texts are equal to each other; a null
``doc_id`` sorts after all others; of rows that agree in text length and id the one read
first stays. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, text_of, unused, with_row_id, written

#: Characters that equality ignores.
SPACE = r"[\x20\x09-\x0D]+"
#: Code points in a block.
BLOCK_CHARS = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _blocks(text: Column, size: int) -> Column:
    """The text in blocks; the empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _route(block: Column, width: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(i), block) for i in range(width)])


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names, unique and equal only for equal rows; sorted within partitions, not over the corpus."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, size: int, width: int, route) -> tuple[DataFrame, int]:
    """Routing key and name of each distinct block; the width of key that tells all apart."""
    while True:
        texts = docs.select(normalised(text_of()).alias("norm"))
        blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block")).distinct()
        names = written(_named(blocks, ["block"]).select(route(F.col("block"), width).alias("route"), "name"), "names")
        if names.groupBy("route").count().filter("count > 1").isEmpty():
            return names, width
        width += 1


def identities(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, width: int = 2, route=_route
) -> tuple[DataFrame, DataFrame]:
    """Rows of the documents and their identities.

    ``docs`` has ``row_id`` (unique), ``doc_id`` and ``text``. Returns the table
    ``row_id, doc_id, n_points, text_sha256`` and the table ``row_id, level, name``.
    """
    names, width = _first_names(docs, block_chars, width, route)
    norm = docs.select("row_id", "doc_id", text_of().alias("text")).select(
        "row_id", "doc_id", F.char_length("text").alias("n_points"), normalised(F.col("text")).alias("norm")
    )
    rows = written(
        norm.select(
            "row_id",
            "doc_id",
            "n_points",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm"), block_chars), lambda b: route(b, width)).alias("routes"),
        ),
        "rows",
    )
    level = 0
    items = (
        rows.select("row_id", F.size("routes").alias("n"), F.posexplode("routes").alias("pos", "route"))
        .join(names, "route")
        .select("row_id", "n", "pos", "name")
    )
    most = rows.agg(F.max(F.size("routes"))).first()[0] or 1
    items = written(items, "items")
    done = []
    while True:
        done.append(items.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        # The right half of a last odd pair is missing: -1, which is no name.
        pairs = (
            items.filter("n > 1")
            .groupBy("row_id", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
            .select("row_id", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "left", "right")
        )
        names = written(_named(pairs.select("left", "right").distinct(), ["left", "right"]), "names")
        items = written(pairs.join(names, ["left", "right"]).select("row_id", "n", "pos", "name"), "items")
        most, level = (most + 1) // 2, level + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return rows.drop("routes"), result


def _groups(docs: DataFrame, block_chars: int, width: int, route) -> DataFrame:
    rows, names = identities(docs, block_chars, width, route)
    named = rows.join(names, "row_id")
    # The smallest struct: most code points, then the smallest id, nulls last.
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")))
    groups = named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Read from a table, so that the join below can split a hot group's rows.
    groups = written(groups, "groups")
    return named.join(groups, ["level", "name"]).select(
        "row_id",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
        "level",
        "name",
    )


def exact_duplicates(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, width: int = 2, route=_route
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, level, name``."""
    ided = with_row_id(documents(docs, "doc_id", "text"))
    return _groups(ided, block_chars, width, route).drop("row_id")


def drop_exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that stay, with all their columns."""
    key = unused(docs, "dedup_row")
    table = written(with_row_id(docs, key), "docs")
    ided = table.select(F.col(key).alias("row_id"), "doc_id", "text")
    gone = _groups(ided, block_chars, 2, _route).filter("not kept").select(F.col("row_id").alias(key))
    return table.join(gone, key, "left_anti").select(*docs.columns)
