"""Money, percentages and rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

EPS = 1e-12


def exact_sum(col: Column) -> Column:
    """Order-independent sum to four decimals; 0 when there is nothing to sum.

    A sum of doubles loses cents at network scale and differs from run to run, a sum
    of wide decimals is several times slower. Whole units and ten-thousandths are
    summed apart as longs, which cannot overflow below 9e18 units.
    """
    x = col.cast("double")
    whole = F.floor(x)
    part = F.rint((x - whole) * 10_000.0).cast("long")
    total = F.sum(whole).cast("decimal(28,4)") + (
        F.sum(part).cast("decimal(24,0)") * F.lit(Decimal("0.0001"))
    )
    return F.coalesce(total, F.lit(0)).cast("decimal(28,4)")


def as_double(col: Column) -> Column:
    return col.cast("double")


def round_array(col: Column, digits: int) -> Column:
    """Rounding of numeric arrays: scale, nearest with ties to even, unscale."""
    scale = float(10**digits)
    return F.rint(col.cast("double") * scale) / scale


def round_exact(col: Column, digits: int) -> Column:
    """Rounding of one binary number: nearest decimal of its exact value, ties to even.

    ``x * 10**digits`` is split into a product and its exact error, which decides
    the cases where the rounded product only looks like a tie.
    """
    x = col.cast("double")
    scale = float(10**digits)
    p = x * scale
    c = x * 134217729.0
    hi = c - (c - x)
    err = (hi * scale - p) + (x - hi) * scale
    tie = F.abs(p - F.floor(p) - 0.5) == 0.0
    up = F.when(err > 0, F.ceil(p)).when(err < 0, F.floor(p)).otherwise(F.rint(p))
    return F.when(tie, up.cast("double")).otherwise(F.rint(p)) / scale


def split_sales_returns(
    quantity: Column, unit_price: Column, line_total: Column, is_return: Column
) -> tuple[Column, Column]:
    """(sales, returns) of one line; see ``line_values`` for the two candidates."""
    sale, credit = line_values(quantity, unit_price, line_total)
    flag = F.coalesce(is_return, F.lit(False))
    return F.when(flag, F.lit(0.0)).otherwise(sale), F.when(flag, credit).otherwise(F.lit(0.0))


def line_values(quantity: Column, unit_price: Column, line_total: Column) -> tuple[Column, Column]:
    """(value if the document is a sale, value if it is a return) of one line.

    Neither depends on the document, so lines can be summed per document before
    they are joined to it.
    """
    q = F.coalesce(quantity.cast("double"), F.lit(0.0))
    p = F.coalesce(unit_price.cast("double"), F.lit(0.0))
    t = F.coalesce(line_total.cast("double"), F.lit(0.0))
    implied = F.abs(q) * F.abs(p)
    value = F.when((q < 0) & (F.abs(t) < EPS), implied).otherwise(t)
    credit = F.when(F.abs(value) > EPS, F.abs(value)).otherwise(implied)
    return F.greatest(value, F.lit(0.0)), credit


def revenue_gel(total: Column, subtotal: Column) -> Column:
    return F.coalesce(total, subtotal, F.lit(0.0)).cast("double")


def pct_or_zero(num: Column, den: Column, floor: float = 0.0) -> Column:
    return F.when(den > floor, num / F.nullif(den, F.lit(0.0)) * 100.0).otherwise(0.0)


def pct_or_null(num: Column, den: Column, floor: float = 1e-9) -> Column:
    return F.when(den > floor, num / F.nullif(den, F.lit(0.0)) * 100.0)


def share_pct(num: Column, total: Column) -> Column:
    """Share of a total that counts as 1 when it is zero."""
    whole = F.coalesce(F.nullif(total.cast("double"), F.lit(0.0)), F.lit(1.0))
    return num.cast("double") / whole * 100.0


def confidence_hash(store_name: Column, start: object, end: object) -> Column:
    """Stable pseudo-confidence from store name and period."""
    key = F.concat(store_name, F.lit(f"|{start}|{end}"))
    head = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    return (F.lit(V.CONFIDENCE_BASE) + head % V.CONFIDENCE_SPAN).cast("int")


def risk_band(rate: Column) -> Column:
    low, medium, high = V.RISK_LABELS
    return (
        F.when(rate <= V.RISK_LOW_MAX, low).when(rate <= V.RISK_MEDIUM_MAX, medium).otherwise(high)
    )


def heat_class(rate: Column) -> Column:
    return (
        F.when(rate > V.HEAT_RED_ABOVE, "red")
        .when(rate < V.HEAT_GREEN_BELOW, "green")
        .otherwise("neutral")
    )


def confidence_band(pct: Column) -> Column:
    return (
        F.when(pct >= V.CONFIDENCE_HIGH, "high")
        .when(pct >= V.CONFIDENCE_MEDIUM, "medium")
        .otherwise("low")
    )
