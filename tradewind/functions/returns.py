"""Classification of return and credit documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import matches


def is_return_document(
    invoice_number: Column | None = None,
    notes: Column | None = None,
    raw_text: Column | None = None,
) -> Column:
    """True when number, notes or raw text say the document is a return; never NULL."""
    tests = []
    if invoice_number is not None:
        tests += [
            matches(invoice_number, "(?i)" + V.RETURN_PHRASES),
            matches(invoice_number, "(?i)" + V.CREDIT_NUMBER_PREFIX),
        ]
    if notes is not None:
        tests.append(matches(notes, "(?i)" + V.RETURN_PHRASES))
    if raw_text is not None:
        tests.append(matches(raw_text, V.RETURN_RAW_TEXT))
    return reduce(
        lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False)
    )


def not_return_by_phrases(
    notes: Column,
    invoice_number: Column,
    note_phrases: Sequence[str] = V.ORDER_NOTE_EXCLUSIONS,
    number_phrases: Sequence[str] = V.ORDER_NUMBER_EXCLUSIONS,
) -> Column:
    """NULL-safe exclusion used for order history: ASCII case-insensitive LIKE."""

    def clean(col: Column, phrases: Sequence[str]) -> Column:
        hit = reduce(lambda a, b: a | b, [col.ilike(f"%{p}%") for p in phrases])
        return col.isNull() | ~hit

    return clean(notes, note_phrases) & clean(invoice_number, number_phrases)


def return_candidate(
    notes: Column, invoice_number: Column, phrase: str = V.RETURN_NOTE_PHRASE
) -> Column:
    hits = [notes.ilike(f"%{phrase}%"), invoice_number.ilike("%CR%"), notes.ilike("%return%")]
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])
