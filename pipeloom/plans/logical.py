"""The bound plan: typed expressions and relational nodes over column identities."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import Span


@dataclass(frozen=True)
class Column:
    """An identity: which value, not which name."""

    number: int
    type: str
    nullable: bool

    @property
    def id(self) -> str:
        return f"c{self.number}"


@dataclass(frozen=True)
class Expr:
    """op: column, number, text, day, null, + - * / neg, cast, a call's name, case, byte/char length, year."""

    op: str
    type: str
    nullable: bool
    args: tuple = ()
    value: object = None
    span: Span = Span(0, 0)


@dataclass(frozen=True)
class Predicate:
    """op: compare, null, distinct, and, or, not, unknown."""

    op: str
    column: Column | None = None
    comparison: str = ""
    value: object = None
    args: tuple = ()


@dataclass(frozen=True)
class Key:
    column: Column
    ascending: bool
    nulls_first: bool


@dataclass
class Node:
    #: Column identities that are visible after this node, in order.
    visible: list = field(default_factory=list, kw_only=True)


@dataclass
class Source(Node):
    table: object
    columns: list  # (Column, stored name)


@dataclass
class Compute(Node):
    kind: str  # select, extend, set, drop, rename, alias, derived
    input: Node
    computed: list  # (Column, Expr)


@dataclass
class Filter(Node):
    input: Node
    predicate: Predicate


@dataclass
class Join(Node):
    input: Node
    right: Node
    outer: bool
    left_key: Column
    right_key: Column
    renewed: list  # (old right Column, new Column)


@dataclass
class Aggregate(Node):
    input: Node
    keys: list  # (Column, new Column)
    entries: list  # (Column, kind, Expr | None, Span)
    ordered: bool


@dataclass
class WindowCount(Node):
    input: Node
    outputs: list
    partition: list


@dataclass
class WindowSum(Node):
    input: Node
    outputs: list  # (Column, Span)
    argument: Column
    partition: list
    order: list  # Key


@dataclass
class Distinct(Node):
    input: Node
    columns: list  # (old Column, new Column)


@dataclass
class SetOperation(Node):
    kind: str  # union, except, intersect
    all: bool
    input: Node
    right: Node
    columns: list  # (left Column, right Column, new Column)


@dataclass
class Order(Node):
    input: Node
    keys: list


@dataclass
class Limit(Node):
    input: Node
    count: int
    offset: int
    keys: list  # the order established below


@dataclass
class Plan:
    root: Node
    output: list  # (name | None, Column)
    order: list  # Key
    arithmetic: list  # spans of expressions with INT64 arithmetic
