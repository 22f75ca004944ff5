"""Parsed, not yet resolved queries."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from ..errors import Span


@dataclass
class Name:
    parts: list[str]  # [column] or [range, column]
    span: Span


# numeric expressions


@dataclass
class Number:
    value: int | float | None  # None: NULL
    span: Span


@dataclass
class Negate:
    operand: object
    span: Span


@dataclass
class Plus:
    operand: object
    span: Span


@dataclass
class Binary:
    op: str
    left: object
    right: object
    span: Span


@dataclass
class Call:
    name: str
    args: list
    span: Span


@dataclass
class Case:
    branches: list  # (op, left, right) with op a comparison or "null" / "not null"; result
    otherwise: object
    span: Span


# whole projection expressions besides those


@dataclass
class Text:
    value: str
    span: Span


@dataclass
class Day:
    value: datetime.date
    span: Span


@dataclass
class TextLength:
    kind: str  # BYTE_LENGTH, CHAR_LENGTH
    argument: object  # Name or Text
    span: Span


@dataclass
class Year:
    argument: object  # Name or Day
    span: Span


@dataclass
class OrderKey:
    name: object  # Name or int position
    ascending: bool
    nulls_first: bool
    span: Span


@dataclass
class Window:
    kind: str  # COUNT, SUM
    argument: Name | None
    partition: list[Name]
    order: list[OrderKey]
    span: Span


@dataclass
class Entry:
    expr: object
    alias: str | None
    span: Span


# predicates


@dataclass
class Compare:
    name: Name
    op: str
    value: object
    span: Span


@dataclass
class IsNull:
    name: Name
    negated: bool
    span: Span


@dataclass
class IsDistinct:
    name: Name
    value: object
    negated: bool  # IS NOT DISTINCT FROM
    span: Span


@dataclass
class InList:
    name: Name
    values: list
    negated: bool
    span: Span


@dataclass
class Between:
    name: Name
    low: object
    high: object
    negated: bool
    span: Span


@dataclass
class Logic:
    op: str  # AND, OR, NOT
    operands: list
    span: Span


# stages


@dataclass
class Source:
    table: str | None
    child: Query | None
    alias: str | None
    span: Span


@dataclass
class Project:
    kind: str  # SELECT, EXTEND
    entries: list[Entry]
    span: Span


@dataclass
class SetColumns:
    items: list  # (name, expr, span)
    span: Span


@dataclass
class Drop:
    names: list  # (name, span)
    span: Span


@dataclass
class Rename:
    pairs: list  # (old, new, span)
    span: Span


@dataclass
class Alias:
    name: str
    span: Span


@dataclass
class Where:
    predicate: object
    span: Span


@dataclass
class AggregateCall:
    kind: str
    argument: object  # None: COUNT(*)
    alias: str
    span: Span


@dataclass
class Aggregate:
    calls: list[AggregateCall]
    keys: list[Name]
    ordered: bool
    span: Span


@dataclass
class Join:
    outer: bool
    right: Source
    left_key: Name
    right_key: Name
    span: Span


@dataclass
class Distinct:
    span: Span


@dataclass
class SetOperation:
    kind: str  # UNION, EXCEPT, INTERSECT
    all: bool
    inputs: list
    span: Span


@dataclass
class Order:
    keys: list[OrderKey]
    span: Span


@dataclass
class Limit:
    count: int
    offset: int
    span: Span


@dataclass
class Query:
    source: Source
    stages: list = field(default_factory=list)
