"""Free-text dates, period presets and day ranges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import find, let, strip, sub


# Year first with one separator, or day first; groups of the other form stay empty.
DATE_TOKEN = (
    r"^(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))$"
)


def parse_date_token(col: Column) -> Column:
    """Date from the first ten characters: y-m-d, y/m/d, d/m/y, d.m.y or d-m-y; else NULL.

    The token is rewritten to ISO order and cast, so calendar validity is checked
    without a formatter exception per row.
    """
    token = strip(F.substring(strip(col), 1, 10))
    return let(
        F.regexp_replace(token, DATE_TOKEN, "=$1$8-$3$7-$4$5"),
        lambda iso: F.when(
            iso.startswith("=") & ~iso.startswith("=0000"),
            F.substring(iso, 2, 10).try_cast("date"),
        ),
    )


def parse_created_at(col: Column) -> Column:
    """Date of an ISO timestamp (extended or basic form), else as ``parse_date_token``."""
    s = strip(col)
    basic = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?:[T ].*)?$", "$1-$2-$3")
    return F.coalesce(
        parse_date_token(s),
        F.when(s.rlike(r"^\d{8}(?:[T ].*)?$"), basic.try_cast("date")),
    )


def effective_date(invoice_date: Column, created_at: Column) -> Column:
    return F.coalesce(parse_date_token(invoice_date), parse_created_at(created_at))


def on_days(col: Column, start: date, end: date) -> Column:
    """Inclusive day range as a half-open comparison that reaches the Parquet scan.

    Works on date and timestamp columns alike without casting the column.
    """
    return (col >= F.lit(start)) & (col < F.lit(end + timedelta(days=1)))


def preset_range(label: str, end: date) -> tuple[date, date]:
    days = V.PRESET_DAYS.get(label, V.DEFAULT_PRESET_DAYS)
    return end - timedelta(days=days - 1), end


def custom_range(
    start: date, end: date, active: tuple[date, date]
) -> tuple[date, date]:
    """A custom range replaces the active one only when it is not reversed."""
    return (start, end) if start <= end else active


def period_days(start: date, end: date) -> int:
    return max(1, (end - start).days + 1)


def extract_document_date(text: Column) -> Column:
    """Date token of a document: under its label, else ISO, else d/m/y anywhere."""
    return F.coalesce(
        find(text, V.DATE_UNDER_LABEL), find(text, V.DATE_ISO), find(text, V.DATE_DMY)
    )


def before_item_table(text: Column) -> Column:
    return sub(text, r"(?s)" + V.ITEM_TABLE_CAPTION + ".*$", "")


def extract_document_time(text: Column, date_token: Column) -> Column:
    """HH:MM:SS under its label, else close to the date token, else before the item table."""
    head = before_item_table(text)
    at = F.when(date_token.isNotNull(), F.instr(head, date_token)).otherwise(0)
    lo = F.greatest(at - V.TIME_BEFORE_DATE, F.lit(1))
    near = F.substring(head, lo, at + V.TIME_AFTER_DATE - lo)
    return F.coalesce(
        find(head, V.TIME_UNDER_LABEL),
        F.when(at > 0, find(near, V.TIME_OF_DAY)),
        find(head, V.TIME_OF_DAY),
    )
