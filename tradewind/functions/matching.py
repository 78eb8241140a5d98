"""Similarity of short names and waybill keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import let, matches, strip, sub


def chars(col: Column) -> Column:
    """Characters of a lower-cased name."""
    return F.split(F.lower(col), "")


def token_set(col: Column) -> Column:
    """Sorted distinct whitespace tokens of a lower-cased name."""
    words = F.split(F.lower(sub(col, r"\s+", " ")), " ")
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: w != "")))


def token_jaccard(a: Column, b: Column) -> Column:
    ta, tb = token_set(a), token_set(b)
    union = F.size(F.array_union(ta, tb))
    return F.when(
        (F.size(ta) > 0) & (F.size(tb) > 0),
        F.size(F.array_intersect(ta, tb)).cast("double") / union,
    ).otherwise(0.0)


def occurrences(ordered: Column) -> Column:
    """Distinct (character, occurrence) marks of sorted characters, as numbers.

    Two multisets of characters share as many characters as their marks intersect.
    """
    return F.transform(
        ordered,
        lambda ch, i: F.ascii(ch).cast("long") * 1_000_000 + (i + 1 - F.array_position(ordered, ch)),
    )


def shared_chars(ca: Column, cb: Column) -> Column:
    """Size of the multiset intersection of two character arrays."""
    marks = [let(F.sort_array(c), lambda s: occurrences(s)) for c in (ca, cb)]
    return F.size(F.array_intersect(*marks))


def char_ratio(a: Column, b: Column) -> Column:
    """2 * shared characters / total characters, 1 for two empty strings."""
    ca, cb = chars(a), chars(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(2.0) * shared_chars(ca, cb) / F.nullif(total, F.lit(0))
    )


def waybill_key_forms(number: Column) -> Column:
    """The number without whitespace, and its part before ``/`` when long enough."""
    s = sub(F.coalesce(number, F.lit("")), r"\s+", "")
    base = F.substring_index(s, "/", 1)
    keys = F.array(s, F.when(s.contains("/") & (F.length(base) >= V.WAYBILL_BASE_MIN), base))
    return F.filter(keys, lambda k: k.isNotNull() & (F.length(k) >= V.WAYBILL_KEY_MIN))


def waybill_keys(invoice_number: Column, text_number: Column) -> Column:
    """Keys that identify one waybill across a document and its appendices.

    ``text_number`` is the waybill number found in the text, if any; numbers that
    are only a file stem do not count.
    """
    number = strip(F.coalesce(invoice_number, F.lit("")))
    usable = F.when(~matches(number, V.STEM_INVOICE), number)
    return F.array_union(waybill_key_forms(text_number), waybill_key_forms(usable))
