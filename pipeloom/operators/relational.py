"""One function per bound node: DataFrames whose columns are the plan's identities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, scalars
from ..functions import text as X
from ..functions.text import Text
from ..plans import logical as L
from . import windows
from .expressions import predicate, value

INT32_MAX, INT64_MAX = 2**31 - 1, 2**63 - 1
#: Copies of a row that are made at once.
CHUNK = 65_536


@dataclass
class Relation:
    df: DataFrame
    #: DATE identity -> column with the timestamp that it was stored as, and that type's keyword.
    stamps: dict[str, tuple[str, str]] = field(default_factory=dict)


class Compiler:
    """``read(table)`` gives a table's DataFrame with its stored column names, and its stamps."""

    def __init__(self, read):
        self.read = read

    def compile(self, node: L.Node) -> Relation:
        return getattr(self, type(node).__name__.lower())(node)

    def source(self, node: L.Source) -> Relation:
        df, stored = self.read(node.table)
        kinds = dict(df.dtypes)
        stamps = {c.id: (f"{c.id}_stamp", "TIMESTAMP_NTZ" if kinds[stored[name]] == "timestamp_ntz" else "TIMESTAMP") for c, name in node.columns if name in stored}
        columns = [f"`{name}` AS {c.id}" for c, name in node.columns]
        columns += [f"`{stored[name]}` AS {c.id}_stamp" for c, name in node.columns if name in stored]
        return Relation(df.selectExpr(*columns), stamps)

    def compute(self, node: L.Compute) -> Relation:
        below = self.compile(node.input)
        if not node.computed:
            return below
        return Relation(below.df.selectExpr("*", *(f"{value(e).sql} AS {c.id}" for c, e in node.computed)), below.stamps)

    def filter(self, node: L.Filter) -> Relation:
        below = self.compile(node.input)
        return Relation(below.df.where(predicate(node.predicate, below.stamps).sql), below.stamps)

    def join(self, node: L.Join) -> Relation:
        left, right = self.compile(node.input), self.compile(node.right)
        rdf, stamps = right.df, right.stamps
        key = node.right_key.id
        if node.renewed:
            new = {old.id: c.id for old, c in node.renewed}
            rdf = rdf.selectExpr(*(f"{c} AS {new.get(c, c)}" for c in rdf.columns))
            key = new[key]
            stamps = {new.get(c, c): s for c, s in stamps.items()}
        condition = X.col(node.left_key.id) == X.col(key)
        if node.left_key.type == "DOUBLE":
            condition = condition & ~X.fn("isnan", X.col(node.left_key.id))  # NaN matches nothing
        return Relation(left.df.join(rdf, condition.column(), "left" if node.outer else "inner"), left.stamps | stamps)

    def aggregate(self, node: L.Aggregate) -> Relation:
        df = self.compile(node.input).df
        # each distinct argument is computed once, under a short name
        arguments: dict[L.Expr, str] = {}
        for _, _, e, _ in node.entries:
            if e is not None and e.op != "column":
                arguments.setdefault(e, f"argument{len(arguments)}__")
        if arguments:
            df = df.selectExpr("*", *(f"{value(e).sql} AS {name}" for e, name in arguments.items()))
        parts: dict[str, str] = {}

        def part(x: Text) -> Text:
            """An aggregate call as a column of the first step."""
            return X.col(parts.setdefault(x.sql, f"part{len(parts)}__"))

        entries = [f"{self.entry(kind, e, span, arguments, part).sql} AS {c.id}" for c, kind, e, span in node.entries]
        calls = [F.expr(f"{sql} AS {name}") for sql, name in parts.items()]
        if not node.keys:
            return Relation(df.agg(*calls).selectExpr(*entries))
        # grouping makes -0.0 and NaN payloads uniform; the first member's own bits stand for its group
        names = {old.id: f"{new.id}_key" if old.type == "DOUBLE" else new.id for old, new in node.keys}
        kept = [F.expr(f"first({old.id}) AS {new.id}") for old, new in node.keys if old.type == "DOUBLE"]
        grouped = df.groupBy(*(F.expr(f"{old} AS {new}") for old, new in names.items())).agg(*kept, *calls)
        return Relation(grouped.selectExpr(*(new.id for _, new in node.keys), *entries))

    def entry(self, kind: str, e: L.Expr | None, span, arguments: dict, part) -> Text:
        if e is None:
            return part(X.fn("count", 1))
        x = X.col(arguments[e]) if e in arguments else value(e)
        if kind == "COUNT":
            return part(X.fn("count", x))
        if kind == "SUM":
            return aggregates.sum_int(x, span, part) if e.type == "INT64" else aggregates.sum_double(x, span, part)
        if kind == "AVG":
            return aggregates.avg_int(x, part) if e.type == "INT64" else aggregates.avg_double(x, part)
        return aggregates.extreme(kind, x, e.type, part)

    def windowcount(self, node: L.WindowCount) -> Relation:
        below = self.compile(node.input)
        return Relation(windows.counted(below.df, node), below.stamps)

    def windowsum(self, node: L.WindowSum) -> Relation:
        below = self.compile(node.input)
        return Relation(windows.summed(below.df, node), below.stamps)

    def distinct(self, node: L.Distinct) -> Relation:
        df = self.compile(node.input).df
        grouped = self.classes(df, [old for old, _ in node.columns], [new.id for _, new in node.columns], None)
        return Relation(grouped)

    def classes(self, df: DataFrame, columns: list, names: list[str], count: str | None) -> DataFrame:
        """One row per class of equal rows, with representatives' own bits; ``count``: a column with its rows."""
        keys = [F.col(c.id).alias(f"{n}_key" if c.type == "DOUBLE" else n) for c, n in zip(columns, names, strict=True)]
        kept = [F.first(c.id).alias(n) for c, n in zip(columns, names, strict=True) if c.type == "DOUBLE"]
        kept += [F.count(F.lit(1)).alias(count)] if count else []
        grouped = df.groupBy(*keys)
        grouped = grouped.agg(*kept) if kept else df.select(*keys).distinct()
        return grouped.select(*names, *([count] if count else []))

    def setoperation(self, node: L.SetOperation) -> Relation:
        left, right = self.compile(node.input).df, self.compile(node.right).df
        names = [new.id for _, _, new in node.columns]
        if node.kind == "union":
            pick = lambda df, k: df.selectExpr(*(f"{row[k].id} AS {row[2].id}" for row in node.columns))
            return Relation(pick(left, 0).union(pick(right, 1)))
        theirs = [f"{n}_r" for n in names]
        ours = self.classes(left, [a for a, _, _ in node.columns], names, "times__")
        other = self.classes(right, [b for _, b, _ in node.columns], theirs, "others__")
        condition = F.expr(" AND ".join(f"{a} <=> {b}" for a, b in zip(names, theirs, strict=True)))
        if not node.all:
            return Relation(ours.join(other, condition, "left_anti" if node.kind == "except" else "left_semi").select(*names))
        others = F.coalesce("others__", F.lit(0))
        copies = F.col("times__") - others if node.kind == "except" else F.least("times__", others)
        counted = lambda df: df.join(other, condition, "left").select(*names, copies.alias("copies__")).where("copies__ > 0")
        return Relation(replicated(counted(ours), counted(ours.where(F.col("times__") > CHUNK)), names))

    def order(self, node: L.Order) -> Relation:
        return self.compile(node.input)  # the order is applied where it counts: at LIMIT and at the result

    def limit(self, node: L.Limit) -> Relation:
        below = self.compile(node.input)
        df = sorted_by(below.df, node.keys)
        if node.count + node.offset > INT32_MAX:
            return Relation(beyond(below.df, node), below.stamps)
        if node.offset:
            df = df.offset(node.offset)
        return Relation(df.limit(node.count), below.stamps)


def replicated(counted: DataFrame, frequent: DataFrame, names: list[str]) -> DataFrame:
    """Each row ``copies__`` times; ``frequent`` has at least the rows with more than ``CHUNK`` copies.

    No array holds more than ``CHUNK`` copies, and many copies of one row are dealt to several tasks.
    """
    one = lambda n: F.explode(F.sequence(F.lit(1).cast("int"), n.cast("int"))).alias("copy__")
    few = counted.where(F.col("copies__") <= CHUNK).select(*names, one(F.col("copies__")))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies__") - 1, F.lit(CHUNK).cast("long"))).alias("start__")
    chunks = frequent.where(F.col("copies__") > CHUNK).select(*names, "copies__", start)
    # a stated number: the chunks are few and small, but what becomes of them isn't
    chunks = chunks.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start__")
    many = chunks.select(*names, one(F.least(F.lit(CHUNK), F.col("copies__") - F.col("start__"))))
    return few.union(many).drop("copy__")


def beyond(df: DataFrame, node: L.Limit) -> DataFrame:
    """LIMIT whose bounds pass Spark's own 32-bit ones: rows are counted in 64 bits, in one task and without holding them."""
    if not node.offset and node.count >= INT64_MAX:
        return sorted_by(df, node.keys)
    keys = [o for k in node.keys for o in scalars.order_by(X.col(k.column.id), k.column.type, k.ascending, k.nulls_first)]
    before = Window.orderBy(*(keys or [F.monotonically_increasing_id()])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumn("place__", F.count(F.lit(1)).over(before))
    last = min(node.offset + node.count, INT64_MAX)
    return placed.where((F.col("place__") > node.offset) & (F.col("place__") <= last)).drop("place__")


def sorted_by(df: DataFrame, keys: list) -> DataFrame:
    order = [o for k in keys for o in scalars.order_by(X.col(k.column.id), k.column.type, k.ascending, k.nulls_first)]
    return df.orderBy(*order) if order else df


def dataframe(plan: L.Plan, read) -> DataFrame:
    """The result, in its established order, with public names (``_N`` for the unnamed column N)."""
    df = sorted_by(Compiler(read).compile(plan.root).df, plan.order)
    return df.selectExpr(*(f"{c.id} AS `{name or f'_{k}'}`" for k, (name, c) in enumerate(plan.output, 1)))


