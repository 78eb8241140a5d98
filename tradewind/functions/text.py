"""String rules for names, addresses and labels, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .unicode import nfc

NBSP = "\u00a0"
# Everything that counts as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str) -> str:
    """Unicode-aware Java pattern, so \\s \\w \\b see Georgian text and NBSP."""
    return "(?U)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(rx(pattern))


def sub(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, rx(pattern), replacement)


def find(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when nothing (or nothing but '') matches."""
    return blank_to_null(F.regexp_extract(col, rx(pattern), group))


def strip(col: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only spaces."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(sub(col, r"\s+", " "))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """One alternation of quoted words: one small expression however long the list."""
    return col.rlike("|".join(rf"\Q{w}\E" for w in words))


def contains_all(col: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col.contains(w) for w in words])


def blank_to_null(col: Column) -> Column:
    """NULL for '', with the value made once: ``nullif`` makes it for the test and for the result."""
    return let(col, lambda v: F.when(v != "", v))


def apply_fixes(col: Column, fixes: Sequence[tuple[str, str]]) -> Column:
    """Ordered regex replacements, each one on the result of the previous."""
    return reduce(lambda c, fix: sub(c, fix[0], fix[1]), fixes, col)


def truncate(col: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when text was cut."""
    s = strip(F.coalesce(col, F.lit("")))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


# --- addresses -----------------------------------------------------------

def normalize_address(col: Column) -> Column:
    """Composed letters; special spaces become spaces, the full-width number sign ``#``; ends trimmed."""
    spaced = F.translate(nfc(F.coalesce(col, F.lit(""))), "\u00a0\u202f\u2007\uff03", "   #")
    return strip(spaced)


def _trim_commas(col: Column) -> Column:
    return strip(sub(sub(strip(col), r"^\s*,\s*", ""), r"\s*,\s*$", ""))


def _cut_first(col: Column, needle: str) -> Column:
    at = F.instr(col, F.lit(needle))
    return F.concat(
        F.substring(col, F.lit(1), at - 1),
        F.substring(col, at + len(needle), F.length(col)),
    )


def strip_supplier_hq(
    col: Column,
    forms: Sequence[str] = V.SUPPLIER_HQ_FORMS,
    pattern: str = V.SUPPLIER_HQ_PATTERN,
    marker: str = V.MISSING_ADDRESS,
) -> Column:
    """struct(rest, found) of a normalised address: the rest without the supplier head office."""
    at = F.regexp_instr(col, F.lit(rx(pattern)))
    size = F.length(F.regexp_extract(col, rx(pattern), 0))
    cut = F.concat(
        F.substring(col, F.lit(1), at - 1), F.substring(col, at + size, F.length(col))
    )
    for form in reversed(forms):
        cut = F.when(col.contains(form), _cut_first(col, form)).otherwise(cut)
    found = (col != marker) & (contains_any(col, forms) | matches(col, pattern))
    return F.struct(
        F.when(found, _trim_commas(cut)).otherwise(col).alias("rest"), found.alias("found")
    )


def branch_code(col: Column, pattern: str = V.BRANCH_CODE) -> Column:
    """Last ``#digits`` of an address once the supplier head office is removed."""

    def last_code(s: Column) -> Column:
        rest = strip_supplier_hq(s)["rest"]
        return F.try_element_at(F.regexp_extract_all(rest, F.lit(rx(pattern)), 1), F.lit(-1))

    return let(normalize_address(col), last_code)


def _snippet(col: Column, n: int) -> Column:
    return let(
        sub(strip(col), r"\s+", "_"),
        lambda s: F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s),
    )


def address_snippet(col: Column, n: int = V.ADDRESS_SNIPPET) -> Column:
    def shown(address: Column) -> Column:
        hq_only = address["found"] & (address["rest"] == "")
        return F.when(hq_only, F.lit(V.UNKNOWN_LOCATION)).otherwise(_snippet(address["rest"], n))

    return let(let(normalize_address(col), lambda s: strip_supplier_hq(s)), shown)


def store_display_name(chain: Column, code: Column, address: Column, store_id: Column) -> Column:
    """Chain plus branch code, else plus address snippet, else plus store id."""
    addr = F.coalesce(address, F.lit(""))
    sid = F.coalesce(store_id.cast("long"), F.lit(0)).cast("string")
    tail = F.when(strip(addr) == V.MISSING_ADDRESS, F.concat(F.lit(" · ID: "), sid)).otherwise("")
    by_address = let(
        address_snippet(addr),
        lambda snip: F.when(F.length(snip) > 0, F.concat(F.lit(" ("), snip, F.lit(")"))),
    )
    suffix = F.coalesce(
        F.concat(F.lit(" (#"), blank_to_null(strip(code)), F.lit(")")),
        F.concat(by_address, tail),
        F.concat(F.lit(" (ID: "), sid, F.lit(")")),
    )
    name = F.coalesce(blank_to_null(strip(chain)), F.lit(V.UNKNOWN_STORE))
    return F.concat(name, suffix)


def unknown_store_name(store_id: Column) -> Column:
    """Display name of a store id that has no store."""
    snippet = V.MISSING_ADDRESS.replace(" ", "_")
    sid = F.coalesce(store_id.cast("long"), F.lit(0)).cast("string")
    return F.concat(F.lit(f"{V.UNKNOWN_STORE} ({snippet}) · ID: "), sid)


def fix_store_name_typos(col: Column, typos: Sequence[tuple[str, str]] = V.STORE_NAME_TYPOS) -> Column:
    return reduce(
        lambda c, t: F.replace(c, F.lit(t[0]), F.lit(t[1])), typos, nfc(F.coalesce(col, F.lit("")))
    )


def clean_store_name(col: Column) -> Column:
    """Legal name without row numbers, taxpayer ids, seller fragments and scan errors."""
    s = strip(F.translate(col, NBSP, " "))
    s = sub(s, V.NAME_ROW_NUMBER, "")
    s = sub(s, V.NAME_SPACED_LEGAL_FORM, "შპს")
    s = sub(s, "(?i)" + V.NAME_INLINE_ID, "")
    s = sub(s, V.NAME_TRAILING_ID, "")
    s = sub(s, V.NAME_LEADING_ID, "")
    s = sub(s, V.NAME_SELLER_NOISE, " ")
    s = strip_chars(sub(s, r"\s+", " "), V.NAME_STRIP_CHARS)
    s = squeeze(apply_fixes(squeeze(s), V.STORE_NAME_FIXES))

    def without_paren(name: Column) -> Column:
        has_form = name.contains(V.LEGAL_FORM_LTD) | name.contains(V.LEGAL_FORM_JSC)
        no_paren = strip_chars(sub(name, V.NAME_TRAILING_PAREN, ""), V.NAME_STRIP_CHARS)
        return F.when(has_form, no_paren).otherwise(name)

    return blank_to_null(let(s, without_paren))


def fix_address_ocr(col: Column) -> Column:
    return blank_to_null(squeeze(apply_fixes(squeeze(col), V.ADDRESS_FIXES)))


def is_hq_address(col: Column, fragments: Sequence[str] = V.HQ_STORE_FRAGMENTS) -> Column:
    return F.coalesce(contains_any(col, fragments), F.lit(False))


def reset_hq_address(col: Column, fragments: Sequence[str] = V.HQ_STORE_FRAGMENTS) -> Column:
    return F.when(~is_hq_address(col, fragments), col)


def address_status(col: Column, fragments: Sequence[str] = V.HQ_STORE_FRAGMENTS) -> Column:
    good = (F.coalesce(col, F.lit("")) != "") & ~is_hq_address(col, fragments)
    return F.when(good, F.lit("ok")).otherwise(F.lit("bad"))


# --- product labels ------------------------------------------------------

def norm_label(
    col: Column,
    replacements: Sequence[tuple[str, str]] = V.LABEL_REPLACEMENTS,
) -> Column:
    """The label with spellings replaced and every run of blanks as one blank."""
    s = F.trim(F.coalesce(col, F.lit("")))
    for old, new in replacements:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.regexp_replace(s, " {2,}", " ")


def clean_product_name(col: Column) -> Column:
    s = strip(F.coalesce(col, F.lit("")))
    return strip(sub(sub(s, V.LABEL_TABLE_PREFIX, ""), V.LABEL_ROW_PREFIX, ""))


def product_from_label(col: Column) -> Column:
    """Product part of ``store · product``."""
    s = strip(F.coalesce(col, F.lit("")))
    after_first = F.substring(s, F.instr(s, F.lit(" · ")) + 3, F.length(s))
    after_last = F.substring_index(s, "·", -1)
    part = F.when(s.contains(" · "), after_first).when(s.contains("·"), after_last).otherwise(s)
    return clean_product_name(part)


def shelf_life(
    col: Column,
    keywords: Sequence[tuple[str, int]] = V.SHELF_LIFE_DAYS,
    default: int = V.SHELF_LIFE_DEFAULT,
) -> Column:
    low = F.lower(col)
    out = F.when(F.lit(False), F.lit(default))
    for word, days in keywords:
        out = out.when(low.contains(word), F.lit(days))
    return out.otherwise(F.lit(default))


def parse_number(col: Column) -> Column:
    """Number with spaces removed and a comma as decimal point; NULL when not a number."""
    s = F.replace(F.translate(col, " " + NBSP, ""), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), s.try_cast("double"))
