"""Helpers shared by the operators: work tables, row ids, numbering within groups."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one block of a two-level numbering holds on average, and the least number of blocks.
ROWS_PER_BLOCK, LEAST_BLOCKS = 100_000, 512


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is missing, below the warehouse, which a cluster shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_llm"
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, lost executors lose nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique id per row. Write the frame before it is read twice: ids follow the partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in itertools.count() if (n := f"_{name}{i}") not in taken)


def blocks_for(rows: int) -> int:
    return max(LEAST_BLOCKS, -(-rows // ROWS_PER_BLOCK))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, blocks: int
) -> DataFrame:
    """Sum of ``value`` over the rows that stand before each row within its group.

    Rows are dealt to ``blocks`` hash blocks of the order columns; each block is sorted by
    itself and only block sums (one row per group and block) are accumulated. A group of
    any size is therefore spread over all tasks. Keys and order columns must not be null.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    df = df.withColumn("_block", block).withColumn("_value", value.cast("long"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_start"))
    )
    within = df.withColumn("_before", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return (
        within.join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_before"))
        .drop("_block", "_value", "_start", "_before")
    )


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in order; all others are left out, whatever their names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
