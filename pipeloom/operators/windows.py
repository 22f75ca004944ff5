"""Window calculations that keep every row.

With PARTITION BY Spark's window does the work.  Without, one window partition
would be one task, so the whole-input forms are computed in a distributed way: a
running sum from one total per key, dealt into ranges of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, scalars
from ..functions import text as X
from ..functions.text import Text
from ..plans import logical as L

#: Ranges of the order keys into which a running total over the whole input is dealt, and how many of their bounds are looked at first.
RANGES, STEP = 1024, 32


def counted(df: DataFrame, node: L.WindowCount) -> DataFrame:
    names = [c.id for c in node.outputs]
    if node.partition:
        n = F.count(F.lit(1)).over(Window.partitionBy(*(c.id for c in node.partition)))
        return df.withColumns(dict.fromkeys(names, n))
    total = df.agg(*(F.count(F.lit(1)).alias(name) for name in names))
    return df.crossJoin(F.broadcast(total))  # one row


def not_after(bound: str, keys: list[L.Key]) -> Text:
    """Whether the key in the struct ``bound`` comes before or with a row's key in the window's order."""
    found = None
    for k, key in reversed(list(enumerate(keys))):
        theirs, ours = Text(f"{bound}.k{k}"), X.col(key.column.id)
        smaller = theirs < ours if key.ascending else theirs > ours
        nulls = (theirs.is_null() & ours.is_not_null()) if key.nulls_first else (theirs.is_not_null() & ours.is_null())
        earlier = nulls | X.fn("coalesce", smaller, False)
        same = theirs.null_safe(ours)
        found = earlier | (same if found is None else same & found)
    return found


def summed(df: DataFrame, node: L.WindowSum) -> DataFrame:
    order = ", ".join(scalars.order_text(X.col(k.column.id), k.column.type, k.ascending, k.nulls_first) for k in node.order)
    x = X.col(node.argument.id)

    def over(partition: list[str]):
        inside = f"PARTITION BY {', '.join(f'`{c}`' for c in partition)} ORDER BY {order}"
        return lambda s: Text(f"({s.sql} OVER ({inside}))")

    if node.partition:
        within = over([c.id for c in node.partition])
        return df.withColumns({c.id: aggregates.sum_int(x, span, within).column() for c, span in node.outputs})
    # One row per key, so that a frequent key is one row.  The ranges' bounds are keys drawn by their hash, about RANGES of
    # all distinct ones: they fit any type and distribution, and a rerun draws the same.
    once = [k for i, k in enumerate(node.order) if k.column.id not in {earlier.column.id for earlier in node.order[:i]}]
    keys = [k.column.id for k in once]
    limbs, names = aggregates.limbs(x), [f"limb{k}__" for k in range(3)]
    sums = [X.fn("sum", limb).column().alias(name) for name, limb in zip(names, limbs, strict=True)]
    totals = df.groupBy(*keys).agg(*sums)
    hashed = f"xxhash64({', '.join(f'`{c}`' for c in keys)})"
    own = f"named_struct({', '.join(f"'k{k}', `{c}`" for k, c in enumerate(keys))})"
    drawn = totals.groupBy(F.expr(f"pmod({hashed}, {RANGES - 1}) AS class__")).agg(F.expr(f"min_by({own}, {hashed}) AS bound__"))
    of_bound = ", ".join(scalars.order_text(Text(f"bound__.k{k}"), key.column.type, key.ascending, key.nulls_first) for k, key in enumerate(once))
    bounds = drawn.selectExpr("bound__", f"row_number() OVER (ORDER BY {of_bound}) AS place__").agg(F.expr("transform(array_sort(collect_list(struct(place__, bound__))), b -> b.bound__) AS bounds__"))
    coarse = f"size(filter(sequence(1, greatest(1, size(bounds__)), {STEP}), i -> {not_after('get(bounds__, i - 1)', once).sql}))"
    first = f"greatest(0, ({coarse} - 1) * {STEP})"
    part = f"({first} + size(filter(slice(bounds__, {first} + 1, {STEP}), b -> {not_after('b', once).sql}))) AS part__"
    dealt = totals.crossJoin(F.broadcast(bounds)).selectExpr(*(f"`{c}`" for c in keys), *names, part)  # one row of up to RANGES keys
    per_part = dealt.groupBy("part__").agg(*(F.sum(name).alias(name) for name in names))
    earlier = "(ORDER BY part__ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"  # over RANGES rows at most
    before = per_part.selectExpr("part__ AS before__", *(f"sum({name}) OVER {earlier} AS {name}b" for name in names))
    within = f"OVER (PARTITION BY part__ ORDER BY {order})"
    running = dealt.selectExpr(*(f"`{c}`" for c in keys), "part__", *(f"sum({name}) {within} AS {name}" for name in names))
    running = running.join(F.broadcast(before), F.expr("part__ = before__"))
    both = lambda name: f"CASE WHEN {name} IS NOT NULL OR {name}b IS NOT NULL THEN coalesce({name}, 0L) + coalesce({name}b, 0L) END AS {name}"
    reached = running.selectExpr(*(f"`{c}` AS key{k}__" for k, c in enumerate(keys)), *map(both, names))
    same = " AND ".join(f"`{c}` <=> key{k}__" for k, c in enumerate(keys))
    joined = df.join(reached, F.expr(same))
    found = joined.withColumns({c.id: aggregates.in_range(aggregates.combined(*map(X.col, names)), span).column() for c, span in node.outputs})
    return found.drop(*names, *(f"key{k}__" for k in range(len(keys))))
