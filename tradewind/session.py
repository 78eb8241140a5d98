"""Spark session settings and shared working folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tradewind")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_smaller_partitions(spark: SparkSession, size: str = "16m") -> SparkSession:
    """A session with the caller's settings whose shuffled partitions are cut at ``size``.

    Sums and sorts of a task take about twenty times the compressed bytes that it reads, so
    partitions merged up to Spark's default of 64 MB cost a task more than a gigabyte. A size
    that the caller has set is kept, and the caller's own session stays as it is.
    """
    return _session_with(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def with_joins_of_dealt_sides(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings whose joins on several keys take sides as they are dealt.

    Two sides that are dealt alike by one of the keys meet without another shuffle; by default
    Spark deals both anew by all keys. Only for sides that one key spreads evenly.
    """
    return _session_with(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _session_with(spark: SparkSession, key: str, wanted: str) -> SparkSession:
    given = spark.conf.getAll
    if key in given:
        return spark
    session = spark.newSession()
    for name, value in given.items():
        if session.conf.isModifiable(name) and session.conf.get(name, None) != value:
            session.conf.set(name, value)
    session.conf.set(key, wanted)
    return session


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor reaches.

    Below ``spark.checkpoint.dir``; where that is not set, below the warehouse, which a
    cluster shares as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_in(folder: str | None, name: str, df: DataFrame) -> DataFrame:
    """The frame written below ``folder`` and read back, so that its lineage ends there.

    Without a folder the frame is planned as it is and no job runs.
    """
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_buckets(folder: str | None, name: str, df: DataFrame, *keys: str) -> DataFrame:
    """The frame as a table of the session's catalog, bucketed and sorted by the keys.

    Joins and sums on the keys read it without another shuffle. The number of buckets is that
    of shuffle partitions, so tables that meet have as many. Without a folder the frame is
    planned as it is and no job runs.
    """
    if folder is None:
        return df
    spark, label = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = label.replace("-", "_")
    # One task per bucket, so that a bucket is one file.
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder.rstrip('/')}/{label}").saveAsTable(table)
    return spark.table(table)
