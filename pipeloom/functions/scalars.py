"""Guarded scalar columns: each function of the language as built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column

from ..errors import Span
from . import text as X
from .text import Text

SPARK_TYPES = {"INT64": "bigint", "DOUBLE": "double", "STRING": "string", "DATE": "date"}
INFINITY, NAN = float("inf"), float("nan")
#: From here on every double is integral.
INTEGRAL = float(2**52)
MARK = "PIPE"


def failure(kind: str, operation: str, span: Span, type_: str) -> Text:
    """An expression that raises when a row demands it; Catalyst doesn't fold it."""
    return X.fn("raise_error", f"{MARK}|{kind}|{operation}|{span[0]}|{span[1]}").cast(SPARK_TYPES[type_])


def null(type_: str) -> Text:
    return X.null(SPARK_TYPES[type_])


def finite(x: Text) -> Text:
    """False for infinities and, as NaN sorts last, for NaN."""
    return X.fn("abs", x) < INFINITY


def overflow_guard(value: Text, inputs: list[Text], operation: str, span: Span) -> Text:
    """Fails where finite inputs made a value that isn't finite."""
    exceeded = reduce(lambda a, b: a & b, [finite(x) for x in inputs], ~finite(value))
    return X.when(exceeded, failure("overflow", operation, span, "DOUBLE")).otherwise(value)


def null_guard(value: Text, inputs: list[Text], operation: str, span: Span) -> Text:
    """Fails where inputs that aren't NULL made a NULL."""
    exceeded = reduce(lambda a, b: a & b, [x.is_not_null() for x in inputs], value.is_null())
    return X.when(exceeded, failure("overflow", operation, span, "INT64")).otherwise(value)


def divide(a: Text, b: Text, span: Span) -> Text:
    zero = a.is_not_null() & (b == 0.0)
    return X.when(zero, failure("zero", "division", span, "DOUBLE")).otherwise(overflow_guard(a / b, [a, b], "division", span))


def safe_divide(a: Text, b: Text) -> Text:
    quotient = a / b
    return X.when(b == 0.0, null("DOUBLE")).otherwise(X.when(~finite(quotient) & finite(a) & finite(b), null("DOUBLE")).otherwise(quotient))


def div(a: Text, b: Text, span: Span) -> Text:
    bad = a.is_not_null() & (b == 0)
    least = (a == -(2**63)) & (b == -1)
    return X.when(bad, failure("zero", "division", span, "INT64")).when(least, failure("overflow", "division", span, "INT64")).otherwise(Text(f"({a.sql} DIV {b.sql})"))


def mod(a: Text, b: Text, span: Span) -> Text:
    return X.when(a.is_not_null() & (b == 0), failure("zero", "division", span, "INT64")).otherwise(a % b)


def absolute(x: Text, type_: str, span: Span) -> Text:
    if type_ == "DOUBLE":
        return X.fn("abs", x)
    return X.when(x == -(2**63), failure("overflow", "absolute value", span, "INT64")).otherwise(X.fn("abs", x))


def sign(x: Text, type_: str) -> Text:
    return X.fn("signum", x).cast("bigint") if type_ == "INT64" else X.when(x == 0.0, X.lit(0.0)).when(X.fn("isnan", x), x).otherwise(X.fn("signum", x))


def _integral(x: Text, inner: Text) -> Text:
    return X.when(X.fn("isnan", x) | (X.fn("abs", x) >= INTEGRAL) | (x == 0.0), x).otherwise(inner)


def floor(x: Text) -> Text:
    return _integral(x, X.fn("floor", x).cast("double"))


def ceil(x: Text) -> Text:
    return _integral(x, X.when((x < 0.0) & (x > -1.0), X.lit(-0.0)).otherwise(X.fn("ceil", x).cast("double")))


def rounded(x: Text) -> Text:
    """Nearest integral value, halves away from zero, keeping the sign of zero."""
    return _integral(x, X.when((x < 0.0) & (x > -0.5), X.lit(-0.0)).otherwise(X.fn("round", x)))


def sqrt(x: Text, span: Span) -> Text:
    return X.when(x < 0.0, failure("domain", "square root", span, "DOUBLE")).otherwise(X.fn("sqrt", x))


def logarithm(x: Text, base_ten: bool, span: Span) -> Text:
    bad = (x <= 0.0) & (x > -INFINITY)
    name = "base-ten logarithm" if base_ten else "natural logarithm"
    return X.when(bad, failure("domain", name, span, "DOUBLE")).when(x == -INFINITY, X.lit(NAN)).otherwise(X.fn("log10" if base_ten else "ln", x))


def exponential(x: Text, span: Span) -> Text:
    return overflow_guard(X.fn("exp", x), [x], "exponentiation", span)


def power(x: Text, y: Text, span: Span) -> Text:
    zero_base = (x == 0.0) & (y < 0.0) & finite(y)
    fraction = (x < 0.0) & finite(x) & finite(y) & (y % 1.0 != 0.0)
    return (
        X.when(x.is_null() | y.is_null(), null("DOUBLE"))
        .when((y == 0.0) | (x == 1.0), X.lit(1.0))
        .when(X.fn("isnan", x), x)
        .when(X.fn("isnan", y), y)
        .when((X.fn("abs", x) == 1.0) & (X.fn("abs", y) == INFINITY), X.lit(1.0))
        .when(zero_base | fraction, failure("domain", "power", span, "DOUBLE"))
        .otherwise(overflow_guard(X.fn("power", x, y), [x, y], "power", span))
    )


def nullif(a: Text, b: Text, type_: str) -> Text:
    same = a == b if type_ == "INT64" else (a == b) & ~X.fn("isnan", a)
    return X.when(same, null(type_)).otherwise(a)


def compare(op: str, a: Text, b: Text, nan_a: bool, nan_b: bool) -> Text:
    """a op b where NaN is unordered; ``nan_a`` and ``nan_b``: whether the side can be NaN."""
    if op == "!=":
        return ~compare("=", a, b, nan_a, nan_b)
    base = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[op]
    if op in ("<", "<="):
        return base & ~X.fn("isnan", b) if nan_b else base
    if op == "=" and not (nan_a and nan_b):
        return base  # NaN equals NaN alone
    return base & ~X.fn("isnan", a) if nan_a else base


def order_by(x: Text, type_: str, ascending: bool, nulls_first: bool) -> list[Column]:
    """Sort columns with NaN below every number and both zeros equal."""
    def directed(key: Text) -> Column:
        c = key.column()
        if ascending:
            return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()

    # isnan of NULL is false, so the flag is made NULL with its value
    return [directed(X.when(x.is_not_null(), ~X.fn("isnan", x))), directed(x)] if type_ == "DOUBLE" else [directed(x)]


def order_text(x: Text, type_: str, ascending: bool, nulls_first: bool) -> str:
    """The same order for a key of a window; DOUBLE has none there."""
    return f"{x.sql} {'ASC' if ascending else 'DESC'} NULLS {'FIRST' if nulls_first else 'LAST'}"
