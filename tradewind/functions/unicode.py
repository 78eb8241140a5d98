"""Canonical composition (NFC) of texts with combining marks, as Column expressions.

Covers the marks of U+0300 to U+036F and every letter that takes them (Latin, Greek, Cyrillic),
and all characters that have one other canonical form. Tables come from the Unicode data of the
driver's Python. A text without marks is one look; in others only a letter and its marks are
taken apart: the letter is decomposed, marks are sorted by their class, and each mark that no
other of its class stands before is composed with the letter if there is such a letter. A letter
with a single mark is looked up by place first; only the others take that longer way.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_MARK, LAST_MARK = 0x300, 0x36F
MARKS = "".join(map(chr, range(FIRST_MARK, LAST_MARK + 1)))
#: All of them but the joiner U+034F, which stands for a letter of its own.
_CLASS = r"\u0300-\u034e\u0350-\u036f"
#: Separators inside the tables; no text that is looked up holds them.
_START, _MID = "\x01", "\x02"


@cache
def _tables() -> tuple[str, str, str, str]:
    """Characters with one other form and those forms; compositions; decompositions."""
    old, new, pairs, parts = [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        whole, full = unicodedata.normalize("NFC", char), unicodedata.normalize("NFD", char)
        if whole == full == char:
            continue
        if whole != char and len(whole) == 1:
            old.append(char)
            new.append(whole)
        elif whole == char and len(full) > 1 and all(c in MARKS for c in full[1:]):
            first = unicodedata.normalize("NFC", full[:-1])
            # The letter without its last mark, and that mark.
            if len(first) == 1:
                pairs.append(_START + first + full[-1] + char)
            parts.append(_START + char + _MID + full)
    return "".join(old), "".join(new), "".join(pairs), "".join(parts) + _START


@cache
def _grid() -> tuple[str, str, str, int]:
    """Compositions of a letter and one mark as lists to be read by place: the row of a letter by
    its code point, the column of a mark, the composed letters row by row, and the row length."""
    pairs = _tables()[2].split(_START)[1:]
    letters = {letter: row for row, letter in enumerate(dict.fromkeys(p[0] for p in pairs), start=1)}
    marks = {mark: column for column, mark in enumerate(dict.fromkeys(p[1] for p in pairs))}
    cells = [""] * ((len(letters) + 1) * (len(marks) + 1))
    for letter, mark, whole in pairs:
        cells[letters[letter] * (len(marks) + 1) + marks[mark]] = whole
    rows = [str(letters.get(chr(point), 0)) for point in range(max(map(ord, letters)) + 1)]
    columns = [str(marks.get(mark, len(marks))) for mark in MARKS]
    return ",".join(rows), ",".join(columns), ",".join(cells), len(marks) + 1


def _paired(cluster: Column) -> Column:
    """The composed letter for a letter and one mark that compose at once, else ''."""
    rows, columns, cells, width = _grid()
    # Lists of literals are made once per query, a look-up costs the same at every place.
    row = F.get(F.split(F.lit(rows), ",").cast("array<int>"), F.ascii(cluster))
    column = F.get(F.split(F.lit(columns), ",").cast("array<int>"), F.ascii(F.substring(cluster, 2, 1)) - F.lit(FIRST_MARK))
    return F.when(F.char_length(cluster) == 2, F.coalesce(F.get(F.split(F.lit(cells), ","), row * width + column), F.lit(""))).otherwise(F.lit(""))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(table: str, key: Column, size: int) -> Column:
    """Up to ``size`` characters behind a key of the table, '' if it is not there."""
    at = F.position(key, F.lit(table))
    return F.when(at > 0, F.substring(F.lit(table), at + F.char_length(key), F.lit(size))).otherwise(F.lit(""))


def _composed(cluster: Column) -> Column:
    """A letter with its marks."""
    _, _, pairs, parts = _tables()
    classes = "".join(chr(0x100 + unicodedata.combining(m)) for m in MARKS)
    one, start, empty = F.lit(1), F.lit(_START), F.lit("")
    letter = F.substring(cluster, 1, 1)
    apart = F.substring_index(_found(parts, F.concat(start, letter, F.lit(_MID)), 8), _START, 1)
    spread = F.concat(F.when(apart == "", letter).otherwise(apart), F.substring(cluster, 2, 1 << 30))

    def order(mark: Column, at: Column) -> Column:
        rank = F.substring(F.lit(classes), F.ascii(mark) - F.lit(FIRST_MARK - 1), one)
        return F.struct(rank.alias("rank"), at.alias("at"), mark.alias("mark"))

    def add(state: Column, m: Column) -> Column:
        together = _found(pairs, F.concat(start, state["letter"], m["mark"]), 1)
        free = (state["left"] == "") | (state["last"] < m["rank"])
        joins = free & (together != "")
        return F.struct(
            F.when(joins, together).otherwise(state["letter"]).alias("letter"),
            F.when(joins, state["left"]).otherwise(F.concat(state["left"], m["mark"])).alias("left"),
            F.when(joins, state["last"]).otherwise(m["rank"]).alias("last"),
        )

    def compose(text: Column) -> Column:
        marks = F.sort_array(F.transform(F.split(F.substring(text, 2, 1 << 30), ""), order))
        first = F.struct(F.substring(text, 1, 1).alias("letter"), empty.alias("left"), empty.alias("last"))
        return F.aggregate(marks, first, add, lambda s: F.concat(s["letter"], s["left"]))

    return _let(spread, compose)


def nfc(col: Column) -> Column:
    """The text in canonical composition; NULL stays NULL."""
    old, new, _, _ = _tables()
    pattern = rf"(?s)[^{_CLASS}][{_CLASS}]+|(?:[^{_CLASS}](?![{_CLASS}]))++|[{_CLASS}]+"

    def whole(text: Column) -> Column:
        each = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        marked = F.transform(
            each,
            lambda c: F.when(
                c.rlike(rf"^[^{_CLASS}][{_CLASS}]"),
                _let(_paired(c), lambda whole: F.when(whole == "", _composed(c)).otherwise(whole)),
            ).otherwise(c),
        )
        return F.when(text.rlike(f"[{_CLASS}]"), F.array_join(marked, "")).otherwise(text)

    # One mark is two others.
    simple = F.translate(F.replace(col, F.lit("̈́"), F.lit("̈́")), old, new)
    return _let(simple, whole)
