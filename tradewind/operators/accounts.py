"""Users, store assignments and the removal of placeholder stores."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text


class Purged(NamedTuple):
    source_files: DataFrame
    stores: DataFrame
    invoices: DataFrame
    items: DataFrame


class MigratedUsers(NamedTuple):
    users: DataFrame
    user_stores: DataFrame
    counts: DataFrame


def _pairs(current: DataFrame, user_id: int, store_ids: Iterable[int]) -> DataFrame:
    rows = [(int(user_id), int(s)) for s in store_ids]
    return current.sparkSession.createDataFrame(rows, "user_id long, store_id long")


def _dealt(pairs: DataFrame, parts: int | None) -> DataFrame:
    """Pairs dealt by store over ``parts`` partitions; those that are dealt so already are not moved."""
    keys = pairs.select("user_id", "store_id")
    return keys if parts is None else keys.repartition(parts, "store_id")


def add_pairs(current: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """Insert or ignore (user, store) pairs.

    With ``parts`` both are dealt by store over so many partitions, so that many pairs which
    were made store by store stay where they are and only the others are shuffled.
    """
    return _dealt(current, parts).unionByName(_dealt(new, parts)).dropDuplicates(["user_id", "store_id"])


def assign_store(current: DataFrame, user_id: int, store_id: int) -> DataFrame:
    return add_pairs(current, _pairs(current, user_id, [store_id]))


def remove_user(current: DataFrame, user_id: int) -> DataFrame:
    return current.filter(F.col("user_id") != user_id)


def replace_user_stores(
    current: DataFrame, user_id: int, store_ids: Iterable[int], also: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """The user's pairs replaced; pairs of ``also`` are added in the same pass over all pairs.

    ``parts`` as in :func:`add_pairs`.
    """
    new = _pairs(current, user_id, store_ids)
    if also is not None:
        new = new.unionByName(also.select("user_id", "store_id"))
    return add_pairs(remove_user(current, user_id), new, parts)


def remove_pairs(current: DataFrame, gone: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs that are not in ``gone``, which is hashed part by part: the many pairs are not sorted.

    Where the pairs are dealt by store over ``parts`` partitions, in a session of
    :func:`~tradewind.session.with_joins_of_dealt_sides`, only ``gone`` is shuffled.
    """
    keys = ["user_id", "store_id"]
    return current.join(_dealt(gone, parts).distinct().hint("shuffle_hash"), keys, "left_anti")


def default_assignment(stores: DataFrame, user_id: int, n: int = 8) -> DataFrame:
    """The first n stores by id that are not the placeholder."""
    first = stores.filter(F.col("name") != V.UNKNOWN_BUYER).orderBy("id").limit(n)
    return first.select(F.lit(user_id).cast("long").alias("user_id"), F.col("id").alias("store_id"))


def load_new_users(users: DataFrame, user_stores: DataFrame, target_users: DataFrame) -> MigratedUsers:
    """Users whose name is not in the target yet, ignoring case, with their stores."""
    key = F.lower(text.strip(F.col("username")))
    keyed = users.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min("id").alias("id"))
    taken = target_users.select(F.lower("username").alias("_key")).distinct()
    chosen = first.join(taken, "_key", "left_anti")
    fresh = (
        users.join(chosen.select("id"), "id", "left_semi")
        .withColumn("username", text.strip(F.col("username")))
        .select(*users.columns)
    )
    pairs = user_stores.join(
        fresh.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    ).select("user_id", "store_id").distinct()
    migrated = fresh.agg(F.count(F.lit(1))).scalar()
    counts = users.agg(F.count(F.lit(1)).alias("total")).select(
        migrated.alias("migrated"), (F.col("total") - migrated).alias("skipped")
    )
    return MigratedUsers(fresh, pairs, counts)


def purge_unknown(
    stores: DataFrame, invoices: DataFrame, items: DataFrame, placeholder: str = V.UNKNOWN_BUYER
) -> Purged:
    """Source files of placeholder-store invoices, and the tables without those stores."""
    gone_stores = stores.filter(F.col("name") == placeholder).select(F.col("id").alias("store_id"))
    gone = invoices.join(gone_stores, "store_id", "left_semi")
    files = gone.filter(F.coalesce("source_file", F.lit("")) != "").select("source_file").distinct()
    return Purged(
        files,
        stores.filter(F.col("name") != placeholder),
        invoices.join(gone_stores, "store_id", "left_anti").select(*invoices.columns),
        items.join(gone.select(F.col("id").alias("invoice_id")), "invoice_id", "left_anti").select(*items.columns),
    )
