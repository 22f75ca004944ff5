"""Exact and overflow-aware aggregates from built-in, partially aggregating functions.

An INT64 sum adds three limbs of 22, 22 and 20 bits, so that no intermediate total
overflows below 2**41 rows; the parts are put together and range-checked at the
end.  A DOUBLE sum also adds the values scaled by 2**-32: if the plain total isn't
finite, the scaled one tells a true overflow or an infinite input from a total
that is in range after all.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from ..errors import Span
from . import text as X
from .scalars import NAN, failure, finite, null
from .text import Text

LIMB, MASK = 22, 2**22 - 1
SCALE = 2.0**-32
LARGEST = 1.7976931348623157e308

Over = Callable[[Text], Text]


def plain(column: Text) -> Text:
    return column


def limbs(x: Text) -> list[Text]:
    return [x.bits(MASK), Text(f"shiftright({x.sql}, {LIMB})").bits(MASK), Text(f"shiftright({x.sql}, {2 * LIMB})")]


def combined(low: Text, middle: Text, high: Text) -> Text:
    wide = "decimal(38,0)"
    return high.cast(wide) * X.lit(Decimal(2 ** (2 * LIMB))) + middle.cast(wide) * X.lit(Decimal(2**LIMB)) + low.cast(wide)


def in_range(total: Text, span: Span) -> Text:
    inside = total.between(X.lit(Decimal(-(2**63))), X.lit(Decimal(2**63 - 1)))
    return X.when(~inside, failure("overflow", "SUM", span, "INT64")).otherwise(total.cast("bigint"))


def sum_int(x: Text, span: Span, over: Over = plain) -> Text:
    """``over`` takes each aggregate call to where its value stands: a window, or a column of a first step."""
    return in_range(combined(*[over(X.fn("sum", limb)) for limb in limbs(x)]), span)


def avg_int(x: Text, over: Over = plain) -> Text:
    total = combined(*[over(X.fn("sum", limb)) for limb in limbs(x)])
    n = over(X.fn("count", x))
    return X.when(n > 0, total.cast("double") / n)


def sum_double(x: Text, span: Span, over: Over = plain) -> Text:
    total, scaled = over(X.fn("sum", x)), over(X.fn("sum", x * SCALE))
    late = X.when(~finite(scaled), scaled).when(X.fn("abs", scaled) <= LARGEST * SCALE, scaled / SCALE).otherwise(failure("overflow", "SUM", span, "DOUBLE"))
    return X.when(total.is_null() | finite(total), total).otherwise(late)


def avg_double(x: Text, over: Over = plain) -> Text:
    total, scaled, n = over(X.fn("sum", x)), over(X.fn("sum", x * SCALE)), over(X.fn("count", x))
    late = X.when(~finite(scaled), scaled).otherwise(scaled / n / SCALE)
    return X.when(n == 0, null("DOUBLE")).when(finite(total), total / n).otherwise(late)


def extreme(kind: str, x: Text, type_: str, over: Over = plain) -> Text:
    """MIN or MAX; a DOUBLE NaN wins, and of both zeros MIN takes -0.0 and MAX 0.0."""
    found = over(X.fn(kind.lower(), x))
    if type_ != "DOUBLE":
        return found
    zero, written = (-0.0, "-0.0") if kind == "MIN" else (0.0, "0.0")
    has_zero = over(X.fn("max", X.when(x == 0.0, x.cast("string") == written).otherwise(False)))
    has_nan = over(X.fn("max", X.fn("isnan", x)))
    return X.when(has_nan, NAN).when((found == 0.0) & has_zero, zero).otherwise(found)
