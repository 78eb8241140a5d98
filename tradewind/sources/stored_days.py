"""Enriched frames stored by the day or month of their effective date.

Free-text dates are parsed once, when a frame is stored. A period or a list of days then
reads the folders of its days or months only.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..session import kept_in

#: Partition column by grain: first day of the grain, NULL where a row has no effective date.
PARTS = {"day": "effective_day", "month": "effective_month"}


def first_day(day: Column, grain: str) -> Column:
    return F.to_date(day) if grain == "day" else F.trunc(day, grain).cast("date")


def grain_of(df: DataFrame) -> str | None:
    """The grain a frame is stored by, None for a frame that is not."""
    return next((grain for grain, part in PARTS.items() if part in df.columns), None)


def parts_of_period(df: DataFrame, start: date, end: date) -> Column | None:
    """Partitions that can hold rows of a period; None for a frame that is not stored by day."""
    grain = grain_of(df)
    if grain is None:
        return None
    first = start if grain == "day" else start.replace(day=1)
    part = F.col(PARTS[grain])
    return (part >= F.lit(first)) & (part < F.lit(end + timedelta(days=1)))


def _dealt(df: DataFrame, grain: str, keys: tuple[str, ...]) -> DataFrame:
    part = PARTS[grain]
    if grain_of(df):
        raise ValueError(f"the frame has a column {PARTS[grain_of(df)]} already")
    return df.withColumn(part, first_day(F.col("effective_date"), grain)).repartitionByRange(part, *keys)


def store_by_day(df: DataFrame, path: str, *keys: str, grain: str = "day", work: str | None = None) -> DataFrame:
    """Write a frame in a folder per day or month and read it back with that column.

    Rows are dealt by ranges of (day, keys): few files per folder, and a day that holds a
    third of all rows is spread over many tasks as long as the keys differ. Ranges are found
    by a sample, which plans the frame a second time; with a ``work`` folder it is written
    there first. The table is replaced as a whole. Days suit tables with much data a day;
    each folder costs at least one file.
    """
    dealt = _dealt(kept_in(work, "by-day", df), grain, keys)
    dealt.write.partitionBy(PARTS[grain]).mode("overwrite").parquet(path)
    return read_by_day(df.sparkSession, path, df.schema, grain)


def read_by_day(spark: SparkSession, path: str, schema: StructType, grain: str = "day") -> DataFrame:
    """A stored frame; ``schema`` is that of the frame before it was stored."""
    whole = StructType([*schema.fields, StructField(PARTS[grain], DateType())])
    return spark.read.schema(whole).parquet(path)


def replace_days(df: DataFrame, path: str, *keys: str, grain: str = "day") -> DataFrame:
    """Replace the folders that the frame has rows for and leave all others as they are."""
    writer = _dealt(df, grain, keys).write.partitionBy(PARTS[grain])
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return read_by_day(df.sparkSession, path, df.schema, grain)
