"""Numbering of rows and surrogate ids, without passing a whole group through one task.

Two ways with one result. Planned: blocks are numbered by windows and their sizes added up, no
job runs. Through a ledger: rows are sorted once over all partitions and written with their
place in their partition; the ledger holds one count per partition, and its running sums turn
places into numbers when the rows are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept_in

BLOCK = 1 << 20
BLOCKS_PER_RUN = 1 << 12


def next_id(df: DataFrame, col: str = "id") -> Column:
    """Largest id in use (0 for an empty table) as a scalar subquery."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()


def hash_block(*cols: str) -> Column:
    """One of about a million blocks by hash of a text key, for keys without a natural order."""
    head = F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 5)
    return F.conv(head, 16, 10).cast("long")


def order_block(col: str | Column, size: int = BLOCK) -> Column:
    """Blocks of consecutive whole numbers; they keep the order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / size).cast("long")


def _offsets(sizes: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows in earlier blocks of the same group, per block."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum("_size").over(before), F.lit(0)))


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    coarse: Column,
    fine: Mapping[str, Column],
    order: Sequence[str],
    name: str,
) -> DataFrame:
    """Number rows 1.. within a group of any size by (coarse, fine, order).

    Blocks must follow the wanted order and ``order`` must be unique in a fine
    block. Rows are numbered inside their fine block in parallel; only block sizes
    are accumulated, first inside a coarse block, then over the coarse blocks.
    """
    fine_cols = {f"_{k}": v for k, v in fine.items()}
    blocked = df.withColumns({"_coarse": coarse, **fine_cols})
    outer = [*group, "_coarse"]
    inner = [*outer, *fine_cols]
    sizes = blocked.groupBy(*inner).agg(F.count(F.lit(1)).alias("_size"))
    fine_off = _offsets(sizes, outer, list(fine_cols), "_fine_off").drop("_size")
    coarse_sizes = sizes.groupBy(*outer).agg(F.sum("_size").alias("_size"))
    coarse_off = _offsets(coarse_sizes, group, ["_coarse"], "_coarse_off").drop("_size")
    within = F.row_number().over(W.partitionBy(*inner).orderBy(*order))
    return (
        blocked.withColumn("_n", within)
        .join(fine_off.join(coarse_off, outer), inner)
        .withColumn(name, (F.col("_n") + F.col("_fine_off") + F.col("_coarse_off")).cast("long"))
        .drop("_n", "_fine_off", "_coarse_off", "_coarse", *fine_cols)
    )


def ledger_numbers(df: DataFrame, order: Sequence[str | Column], work: str, name: str) -> DataFrame:
    """Add the place 1, 2, ... of each row in the order over all rows, through a ledger.

    Rows are range-partitioned once, by bounds that Spark samples, and written; what they are
    read from is best a written table too, as sampling reads it once more. Equal rows have any
    order. A lost executor costs the partitions it held, numbers do not change: they are read
    from files.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = kept_in(work, "numbered", ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ledger = (
        rows.groupBy("_part")
        .agg((F.max("_place") + 1).alias("_size"))
        .select(F.col("_part").alias("_part"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    # One row per partition that was written.
    return (
        rows.join(F.broadcast(ledger), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def ledger_ranks(df: DataFrame, group: Sequence[str], order: Sequence[str], work: str, name: str) -> DataFrame:
    """Number rows 1.. within each group, of any size: places over all rows, less the group's first."""
    placed = kept_in(work, "ranked", ledger_numbers(df, [*group, *order], work, "_at"))
    first = placed.groupBy(*group).agg(F.min("_at").alias("_first"))
    return (
        placed.join(first.select(*[F.col(g).alias(g) for g in group], "_first"), list(group))
        .withColumn(name, F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_first")
    )


def assign_ids(
    df: DataFrame,
    blocks: Sequence[Column],
    order: Sequence[str],
    after: Column,
    name: str = "id",
    work: str | None = None,
) -> DataFrame:
    """Add ids ``after + 1 ...`` ordered by (blocks, order); ``order`` must be unique.

    ``blocks`` are whole numbers that follow the wanted order. With a ``work`` folder ids are
    given through a ledger. Without one, rows are numbered inside their block; block sizes are
    added up inside runs of ``BLOCKS_PER_RUN`` blocks, and only one row per run in a single task.
    """
    if work is not None:
        placed = ledger_numbers(df, [*blocks, *order], work, "_at")
        return placed.withColumn(name, (after + F.col("_at")).cast("long")).drop("_at")
    keys = [f"_block{i}" for i in range(len(blocks))]
    blocked = df.withColumns(dict(zip(keys, blocks)))
    run = F.floor(F.col(keys[0]) / BLOCKS_PER_RUN).alias("_run")
    sizes = blocked.groupBy(run, *keys).agg(F.count(F.lit(1)).alias("_size"))
    runs = sizes.groupBy("_run").agg(F.sum("_size").alias("_size"))
    starts = _offsets(sizes, ["_run"], keys, "_off").drop("_size")
    run_starts = _offsets(runs, [], ["_run"], "_run_off").drop("_size")
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        blocked.withColumn("_n", within)
        .join(starts.join(run_starts, "_run"), keys)
        .withColumn(name, (after + F.col("_run_off") + F.col("_off") + F.col("_n")).cast("long"))
        .drop(*keys, "_run", "_n", "_off", "_run_off")
    )
