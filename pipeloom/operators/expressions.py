"""Bound expressions and predicates as SQL text for Spark."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from ..functions import scalars
from ..functions import text as X
from ..functions.text import Text
from ..plans import logical as L

ARITHMETIC = ("+", "-", "*", "neg")
TRIED = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "neg": "try_subtract"}


def as_double(e: L.Expr) -> Text:
    c = value(e)
    return c if e.type == "DOUBLE" else c.cast("double")


def as_type(e: L.Expr, type_: str) -> Text:
    return as_double(e) if type_ == "DOUBLE" else value(e)


#: Operations that fail for some arguments.
FAILING = (*ARITHMETIC, "/", "DIV", "MOD", "ABS", "SQRT", "LN", "LOG10", "EXP", "POW", "POWER")


def may_fail(e: L.Expr) -> bool:
    return e.op in FAILING or e.op == "case" or any(may_fail(a) for a in e.args)


#: Arguments whose text is longer together are named once instead of being repeated in the text of a guarded operation.
INLINE = 400


def bound(args: list[Text], body: Callable[..., Text]) -> Text:
    """``body`` of arguments that are each evaluated once, and before it, however often it uses them."""
    if sum(len(a.sql) for a in args) <= INLINE:
        return body(*args)
    fields = ", ".join(f"'a{k}', {a.sql}" for k, a in enumerate(args))
    names = [Text(f"bound__.a{k}") for k in range(len(args))]
    return Text(f"(transform(array(named_struct({fields})), bound__ -> {body(*names).sql})[0])")


def both(a: L.Expr, b: L.Expr, x: Text, y: Text, found: Text, type_: str) -> Text:
    """``found`` of the arguments x and y, where y is evaluated, and may fail, also beside a NULL x."""
    if not (a.nullable and may_fail(b)):
        return found
    return X.when(x.is_null() & y.is_null(), X.null(type_)).otherwise(found)


def value(e: L.Expr) -> Text:
    """The column of an expression, with its failures guarded."""
    if e.op in ARITHMETIC:
        return arithmetic(e)
    if e.op == "column":
        return X.col(e.value.id)
    if e.op in ("number", "text", "day"):
        return X.lit(e.value)
    if e.op == "null":
        return scalars.null("INT64")
    if e.op == "BYTE_LENGTH":
        return X.fn("octet_length", value(e.args[0])).cast("bigint")
    if e.op == "CHAR_LENGTH":
        return X.fn("char_length", value(e.args[0])).cast("bigint")
    if e.op == "YEAR":
        return X.fn("year", value(e.args[0])).cast("bigint")
    if e.op == "case":
        return case(e)
    return call(e)


def apply(op: str, args: list[Text]) -> Text:
    if op == "neg":
        return -args[0]
    a, b = args
    return a + b if op == "+" else a - b if op == "-" else a * b


class Chain:
    """A tree of + - * of one type without guards inside: its leaves, and how it is computed from them.

    DOUBLE values that aren't finite stay so up to the top, as does the NULL of an INT64
    operation that overflows: where the top is as it should be nothing below failed.
    What lies deeper than ``DEPTH`` operations is a chain of its own, and here a leaf.
    """

    DEPTH = 6

    def __init__(self, e: L.Expr):
        self.expr = e
        self.leaves: list[tuple[L.Expr, Text]] = []
        self.gather(e, 0)

    def inner(self, e: L.Expr, depth: int) -> bool:
        return e.op in ARITHMETIC and e.type == self.expr.type and depth < self.DEPTH

    def gather(self, e: L.Expr, depth: int) -> None:
        if self.inner(e, depth):
            for a in e.args:
                self.gather(a, depth + 1)
        elif e.op != "number":
            self.leaves.append((e, as_double(e) if self.expr.type == "DOUBLE" else value(e)))

    def operations(self, leaves: list[Text]) -> list[tuple[list[Text], Text]]:
        """(arguments, value) of each operation, the top one last."""
        found: list[tuple[list[Text], Text]] = []
        rest = iter(leaves)

        def add(e: L.Expr, depth: int) -> Text:
            if self.inner(e, depth):
                args = [add(a, depth + 1) for a in e.args]
                if e.type == "DOUBLE":
                    made = apply(e.op, args)
                else:
                    made = X.fn(TRIED[e.op], *([X.lit(0), *args] if e.op == "neg" else args))
                found.append((args, made))
                return made
            if e.op == "number":
                return X.lit(float(e.value) if self.expr.type == "DOUBLE" else e.value)
            return next(rest)

        add(self.expr, 0)
        return found


def arithmetic(e: L.Expr) -> Text:
    chain, double = Chain(e), e.type == "DOUBLE"

    def guarded(*leaves: Text) -> Text:
        operations = chain.operations(list(leaves))
        top = operations[-1][1]
        if double and not leaves:
            return top
        risky = [c for (leaf, _), c in zip(chain.leaves, leaves, strict=True) if may_fail(leaf)]
        if len(operations) == 1 and not risky:
            return (scalars.overflow_guard if double else scalars.null_guard)(top, list(leaves), "arithmetic", e.span)
        good = scalars.finite if double else Text.is_not_null
        failed = [reduce(lambda a, b: a & b, [good(x) for x in args], ~good(made) if double else made.is_null()) for args, made in operations]
        exceeded = reduce(lambda a, b: a | b, failed)
        if risky:  # each is evaluated, whatever is NULL beside it
            exceeded = X.fn("greatest", *(c.is_null() for c in risky), True) & exceeded
        return X.when(good(top), top).when(exceeded, scalars.failure("overflow", "arithmetic", e.span, e.type)).otherwise(top)

    return bound([c for _, c in chain.leaves], guarded)


def call(e: L.Expr) -> Text:
    name, span = e.op, e.span
    if name == "COALESCE":
        return X.fn("coalesce", *(as_type(a, e.type) for a in e.args))
    if name in ("DIV", "MOD", "ABS", "SIGN"):
        args = [value(a) for a in e.args]
    else:
        args = [as_type(a, e.type) if name == "NULLIF" else as_double(a) for a in e.args]
    return bound(args, lambda *found: guarded_call(e, name, span, list(found)))


def guarded_call(e: L.Expr, name: str, span, args: list[Text]) -> Text:
    two = lambda found, type_: both(*e.args, *args, found, type_)
    if name in ("DIV", "MOD"):
        return two((scalars.div if name == "DIV" else scalars.mod)(*args, span), "bigint")
    if name == "ABS":
        return scalars.absolute(args[0], e.type, span)
    if name == "SIGN":
        return scalars.sign(args[0], e.type)
    if name == "NULLIF":
        return two(scalars.nullif(*args, e.type), scalars.SPARK_TYPES[e.type])
    if name == "/":
        divisor = e.args[1]
        if divisor.op == "number" and float(divisor.value) != 0:
            return scalars.overflow_guard(args[0] / args[1], [args[0]], "division", span)
        return two(scalars.divide(*args, span), "double")
    if name == "SAFE_DIVIDE":
        return two(scalars.safe_divide(*args), "double")
    simple = {"CAST": lambda x: x, "FLOOR": scalars.floor, "CEIL": scalars.ceil, "CEILING": scalars.ceil, "ROUND": scalars.rounded}
    if name in simple:
        return simple[name](*args)
    if name in ("LN", "LOG10"):
        return scalars.logarithm(args[0], name == "LOG10", span)
    if name in ("POW", "POWER"):
        return two(scalars.power(*args, span), "double")
    return {"SQRT": scalars.sqrt, "EXP": scalars.exponential}[name](*args, span)


def case(e: L.Expr) -> Text:
    branches, results = e.value
    found = None
    for (op, a, b), result in zip(branches, results, strict=False):
        if b is None:
            condition = value(a).is_null() if op == "null" else value(a).is_not_null()
        else:
            double = "DOUBLE" in (a.type, b.type)
            x, y = (as_double(a), as_double(b)) if double else (value(a), value(b))
            condition = scalars.compare(op, x, y, a.type == "DOUBLE" and a.op != "number", b.type == "DOUBLE" and b.op != "number")
            condition = both(a, b, x, y, condition, "boolean")
        branch = as_type(result, e.type)
        found = X.when(condition, branch) if found is None else found.when(condition, branch)
    return found.otherwise(as_type(results[-1], e.type))


def predicate(p: L.Predicate, stamps: dict[str, tuple[str, str]]) -> Text:
    """A three-valued condition.  ``stamps``: DATE columns whose stored timestamp is at hand, to let the scan see the filter."""
    if p.op == "not":
        return ~predicate(p.args[0], stamps)
    if p.op in ("and", "or"):
        parts = [predicate(x, stamps) for x in p.args]
        return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), parts)
    c, type_ = X.col(p.column.id), p.column.type
    if p.op == "null":
        return c.is_null()
    if p.op == "unknown":
        return X.null("boolean")
    constant = p.value
    if p.op == "distinct":
        if constant is None:
            return c.is_not_null()
        if isinstance(constant, float) and type_ == "INT64":
            c = c.cast("double")
        return ~c.null_safe(X.lit(float(constant) if type_ == "DOUBLE" else constant))
    if type_ == "DATE" and p.column.id in stamps:
        return on_stamp(p.comparison, stamps[p.column.id], constant)
    if type_ == "DOUBLE":
        constant = float(constant)
    elif isinstance(constant, float):
        return scalars.compare(p.comparison, c.cast("double"), X.lit(constant), False, False)
    return scalars.compare(p.comparison, c, X.lit(constant), type_ == "DOUBLE", False)


def on_stamp(op: str, stamp: tuple[str, str], day: datetime.date) -> Text:
    """Compare the day of a timestamp, in terms of the timestamp.  ``stamp``: its column, and its type as a literal's keyword."""
    name, kind = stamp
    if op in ("=", "!="):
        inside = on_stamp(">=", stamp, day) & on_stamp("<=", stamp, day)
        return inside if op == "=" else ~inside
    c = X.col(name)
    if op in (">", "<=") and day == datetime.date.max:
        return c.is_not_null() & X.lit(op == "<=")
    edge = day + datetime.timedelta(days=1) if op in (">", "<=") else day
    literal = Text(f"{kind} '{edge.isoformat()} 00:00:00'")
    return c >= literal if op in (">", ">=") else c < literal
