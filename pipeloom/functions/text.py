"""Column expressions as SQL text.

Building a guarded expression from Spark ``Column`` objects costs a round trip to
the JVM for every operator.  Here operators compose text, and the finished
expression becomes a ``Column`` in one call.
"""

from __future__ import annotations

import datetime
import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


class Text:
    """A parenthesised SQL expression with the operators of a ``Column``."""

    __slots__ = ("sql",)
    __hash__ = None

    def __init__(self, sql: str):
        self.sql = sql

    def _binary(self, op: str, other: object) -> Text:
        return Text(f"({self.sql} {op} {lit(other).sql})")

    def _reflected(self, op: str, other: object) -> Text:
        return Text(f"({lit(other).sql} {op} {self.sql})")

    __add__, __radd__ = (lambda s, o: s._binary("+", o)), (lambda s, o: s._reflected("+", o))
    __sub__, __rsub__ = (lambda s, o: s._binary("-", o)), (lambda s, o: s._reflected("-", o))
    __mul__, __truediv__, __mod__ = (lambda s, o: s._binary("*", o)), (lambda s, o: s._binary("/", o)), (lambda s, o: s._binary("%", o))
    __eq__, __ne__ = (lambda s, o: s._binary("=", o)), (lambda s, o: s._binary("!=", o))  # type: ignore[assignment]
    __lt__, __le__ = (lambda s, o: s._binary("<", o)), (lambda s, o: s._binary("<=", o))
    __gt__, __ge__ = (lambda s, o: s._binary(">", o)), (lambda s, o: s._binary(">=", o))
    __and__, __or__ = (lambda s, o: s._binary("AND", o)), (lambda s, o: s._binary("OR", o))

    def __invert__(self) -> Text:
        return Text(f"(NOT {self.sql})")

    def __neg__(self) -> Text:
        return Text(f"(- {self.sql})")

    def cast(self, type_: str) -> Text:
        return Text(f"CAST({self.sql} AS {type_})")

    def is_null(self) -> Text:
        return Text(f"({self.sql} IS NULL)")

    def is_not_null(self) -> Text:
        return Text(f"({self.sql} IS NOT NULL)")

    def null_safe(self, other: object) -> Text:
        return self._binary("<=>", other)

    def between(self, low: object, high: object) -> Text:
        return Text(f"({self.sql} BETWEEN {lit(low).sql} AND {lit(high).sql})")

    def bits(self, mask: int) -> Text:
        return self._binary("&", mask)

    def column(self) -> Column:
        return F.expr(self.sql)


class When(Text):
    """CASE WHEN ... that more branches can be added to; as it stands it has no ELSE."""

    __slots__ = ("branches",)

    def __init__(self, branches: str):
        self.branches = branches
        super().__init__(f"(CASE{branches} END)")

    def when(self, condition: Text, value: object) -> When:
        return When(f"{self.branches} WHEN {condition.sql} THEN {lit(value).sql}")

    def otherwise(self, value: object) -> Text:
        return Text(f"(CASE{self.branches} ELSE {lit(value).sql} END)")


def when(condition: Text, value: object) -> When:
    return When("").when(condition, value)


def col(name: str) -> Text:
    return Text(f"`{name}`")


def fn(name: str, *args: object) -> Text:
    return Text(f"{name}({', '.join(lit(a).sql for a in args)})")


def null(type_: str) -> Text:
    return Text(f"CAST(NULL AS {type_})")


def lit(value: object) -> Text:
    """A constant; text passes through."""
    if isinstance(value, Text):
        return value
    if value is None:
        return Text("NULL")
    if isinstance(value, bool):
        return Text("true" if value else "false")
    if isinstance(value, int):
        return Text(f"({value}L)" if value < 0 else f"{value}L")
    if isinstance(value, float):
        if math.isfinite(value):
            return Text(f"({value!r}D)" if math.copysign(1, value) < 0 else f"{value!r}D")
        return Text(f"CAST('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}' AS DOUBLE)")
    if isinstance(value, Decimal):
        return Text(f"({value}BD)")
    if isinstance(value, datetime.date):
        return Text(f"DATE '{value.isoformat()}'")
    if isinstance(value, str):
        if re.fullmatch(r"[A-Za-z0-9 _.,:;|#+/-]*", value):
            return Text(f"'{value}'")
        return Text(f"CAST(X'{value.encode().hex()}' AS STRING)")
    raise TypeError(f"no constant: {value!r}")
