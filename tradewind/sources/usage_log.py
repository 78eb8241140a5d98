"""Assistant usage log: JSON lines with a cost per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.money import exact_sum, round_exact
from ..schema import table_schema


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log and their fields; ``broken`` holds a line that is no record of this kind."""
    schema = table_schema("usage_log").add("broken", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of the log; lines that can't be read are told by :func:`read_usage_errors`."""
    return _parsed(spark, path).filter("broken IS NULL").drop("broken")


def read_usage_errors(spark: SparkSession, path: str) -> DataFrame:
    """``line``: what can't be read, whole."""
    return _parsed(spark, path).filter("broken IS NOT NULL").select(F.col("broken").alias("line"))


def cache_write_cost(tokens: Column, usd_per_million: float = V.CACHE_WRITE_USD_PER_MILLION) -> Column:
    return round_exact(tokens.cast("double") * usd_per_million / 1_000_000.0, 6)


def usage_costs(usage: DataFrame) -> DataFrame:
    """Token total and estimated cache write cost per row; absent counts are 0."""
    zero = F.lit(0).cast("long")
    made = F.coalesce(F.col("cache_creation_input_tokens"), zero)
    return usage.withColumns(
        {
            "tokens_used": F.coalesce("input_tokens", zero) + F.coalesce("output_tokens", zero),
            "cache_creation_cost_usd_est": cache_write_cost(made),
        }
    )


def usage_by_user_model(usage: DataFrame) -> DataFrame:
    """Calls, tokens and cost per user and model."""
    costs = usage_costs(usage)
    return costs.groupBy("user_id", "model").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("tokens_used").alias("tokens_used"),
        F.sum(F.col("cache_creation_cost_usd_est").cast("decimal(18,6)"))
        .cast("double")
        .alias("cost_usd"),
    )
