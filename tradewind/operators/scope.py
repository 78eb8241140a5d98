"""Row filters: period, store scope, search, placeholder stores."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates
from ..functions.text import let
from ..sources.stored_days import PARTS, first_day, grain_of, parts_of_period
from ..sources.tables import Star


def filter_by_date_range(df: DataFrame, col: str, start: date, end: date) -> DataFrame:
    """Inclusive day filter; a frame without the column is returned unchanged.

    A frame stored by day or month is filtered on that as well, so that others are not read.
    """
    if col not in df.columns:
        return df
    kept = df.filter(dates.on_days(F.col(col), start, end))
    parts = parts_of_period(df, start, end) if col == "effective_date" else None
    return kept if parts is None else kept.filter(parts)


def period_mask(df: DataFrame, start: date, end: date) -> Column:
    """Effective date in range, or no effective date and the creation date in range."""
    effective = F.col("effective_date")
    if "created_at_raw" not in df.columns:
        return dates.on_days(effective, start, end)
    day = F.coalesce(effective, dates.parse_created_at(F.col("created_at_raw")))
    return let(day, lambda d: dates.on_days(d, start, end))


def in_period(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of ``period_mask``; of a frame stored by day, other days are not read."""
    kept = df.filter(period_mask(df, start, end))
    parts = parts_of_period(df, start, end)
    # Rows without an effective date are stored together and may count by their creation.
    return kept if parts is None else kept.filter(parts | F.col(PARTS[grain_of(df)]).isNull())


def on_listed_days(df: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Rows of the days in a frame, rows without a date left out.

    A frame stored by day reads only those days: the list becomes a partition filter when
    the query runs.
    """
    grain = grain_of(df)
    listed = days.select(F.to_date(day).alias("listed_day")).distinct()
    same = F.to_date("effective_date") == F.col("listed_day")
    if grain:
        same &= F.col(PARTS[grain]) == first_day(F.col("listed_day"), grain)
    return df.join(listed, same, "left_semi")


def user_scope(users: DataFrame, user_stores: DataFrame, username: str) -> DataFrame | None:
    """Allowed store ids of a user: None for a manager, empty for nobody or nothing assigned."""
    user = users.filter(F.lower("username") == username.strip().lower())
    if not user.filter(F.col("role") == "manager").isEmpty():
        return None
    mine = user.select(F.col("id").alias("user_id"))
    return user_stores.join(mine, "user_id", "left_semi").select("store_id").distinct()


def scope_filter(df: DataFrame, allowed: DataFrame | Iterable[int] | None) -> DataFrame:
    """Rows of allowed stores: None keeps all, an empty set keeps none.

    A frame of ids becomes a semi join; a list given by the caller an IN filter.
    """
    if allowed is None:
        return df
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select("store_id").distinct(), "store_id", "left_semi")
    ids = sorted({int(i) for i in allowed})
    return df.filter(F.col("store_id").isin(ids) if ids else F.lit(False))


def scope_frames(
    invoices: DataFrame, lines: DataFrame, allowed: DataFrame | Iterable[int] | None
) -> tuple[DataFrame, DataFrame]:
    """Both frames in scope; lines without a store id follow their invoices."""
    if allowed is None:
        return invoices, lines
    inv = scope_filter(invoices, allowed)
    if "store_id" in lines.columns:
        return inv, scope_filter(lines, allowed)
    return inv, lines.join(inv.select("invoice_id"), "invoice_id", "left_semi")


def scope_star(star: Star, allowed: DataFrame | Iterable[int] | None) -> Star:
    """Scope before any aggregate. Reports join lines to invoices, so invoices decide."""
    return star._replace(invoices=scope_filter(star.invoices, allowed))


def named_in(name: Column, prompt: str, keywords: Sequence[str] = V.STORE_KEYWORDS) -> Column:
    """True where a store name contains a known keyword or ``#code`` that the prompt names."""
    name = F.coalesce(name, F.lit(""))
    hits = [F.lower(name).contains(k.lower()) for k in keywords if k in prompt]
    code = re.search(r"#(\d+)", prompt)
    if code:
        hits.append(name.contains("#" + code.group(1)))
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def store_focus(
    df: DataFrame, prompt: str, name_col: str = "store_display_name",
    keywords: Sequence[str] = V.STORE_KEYWORDS,
) -> DataFrame:
    """Rows whose store name contains a known keyword or ``#code`` that the prompt names."""
    return df.filter(named_in(F.col(name_col), prompt, keywords))


def exclude_unknown_store(stores: DataFrame, placeholder: str = V.UNKNOWN_BUYER) -> DataFrame:
    return stores.filter(F.col("name") != placeholder)


def store_search(stores: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of name or address; blank text keeps all."""
    if not text:
        return stores
    needle = text.lower()
    return stores.filter(
        F.lower("name").contains(needle)
        | F.lower(F.coalesce("address", F.lit(""))).contains(needle)
    )
