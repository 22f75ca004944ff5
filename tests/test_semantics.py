"""Literal expectations, with independent Python models where the domain is small."""

from __future__ import annotations

import datetime
import itertools
import math
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pipeloom import errors as E
from pipeloom.engine import Engine, Table, row_type
from pipeloom.operators import relational, windows

NAN, INF, BIG = math.nan, math.inf, 1.7976931348623157e308
MIN, MAX = -(2**63), 2**63 - 1


def engine(spark, **tables) -> Engine:
    """tables: name=(columns, rows), columns as 'name TYPE [required]'."""
    found = Engine(spark)
    for name, (columns, rows) in tables.items():
        parsed = [(c.split()[0], c.split()[1], "required" not in c) for c in columns.split(", ")]
        frame = spark.createDataFrame(rows, row_type([(n, t, True) for n, t, _ in parsed]))
        found.register_table(Table(name, parsed, frame, {}))
    return found


def bits(x):
    return struct.pack(">d", x).hex() if isinstance(x, float) else x


def same(found, expected):
    show = lambda rows: Counter(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    assert show(found) == show(expected)


@pytest.fixture(scope="module")
def small(spark):
    return engine(
        spark,
        facts=("k INT64, v INT64 required", [(1, 10), (1, 20), (2, 30), (None, 40)]),
        dims=("k INT64, label STRING required", [(1, "a"), (1, "b"), (2, "c"), (None, "null")]),
        d=("id INT64 required, x DOUBLE", [(1, NAN), (2, -0.0), (3, 0.0), (4, INF), (5, -INF), (6, None), (7, 1.5), (8, -2.5)]),
        t=("s STRING, d DATE", [("", datetime.date(1, 1, 1)), ("é", datetime.date(9999, 12, 31)), (None, None), ("a\0b", datetime.date(2000, 2, 29))]),
        n=("a INT64, b INT64", [(x, y) for x in (None, 0, 1, 2) for y in (None, 0, 1, 2)]),
        edge=("id INT64 required, i INT64", [(1, MIN), (2, MAX), (3, -7), (4, 0), (5, None)]),
    )


def rows(e, text):
    return e.prepare(text).rows()


def test_joins(small):
    same(rows(small, "FROM facts AS f |> JOIN dims AS d ON f.k = d.k |> SELECT f.v, d.label"), [(10, "a"), (10, "b"), (20, "a"), (20, "b"), (30, "c")])
    same(rows(small, "FROM facts AS f |> LEFT JOIN dims AS d ON d.k = f.k |> SELECT f.v, d.label"), [(10, "a"), (10, "b"), (20, "a"), (20, "b"), (30, "c"), (40, None)])
    p = small.prepare("FROM facts AS f |> LEFT JOIN dims AS d ON f.k = d.k")
    assert [c[2] for c in p.columns] == [True, False, True, True]


def test_double_join_keys(small):
    same(rows(small, "FROM d AS a |> JOIN d AS b ON a.x = b.x |> SELECT a.id AS i, b.id AS j"), [(2, 2), (2, 3), (3, 2), (3, 3), (4, 4), (5, 5), (7, 7), (8, 8)])
    same(rows(small, "FROM d AS a |> LEFT JOIN d AS b ON a.x = b.x |> WHERE b.id IS NULL |> SELECT a.id AS i"), [(1,), (6,)])


@pytest.mark.parametrize(
    ("predicate", "ids"),
    [
        ("x > 0", {4, 7}), ("x >= 0", {2, 3, 4, 7}), ("x < 0", {5, 8}), ("x <= 0", {2, 3, 5, 8}), ("x = 0", {2, 3}), ("x != 0", {1, 4, 5, 7, 8}), ("NOT x < 0", {1, 2, 3, 4, 7}), ("NOT x >= 0", {1, 5, 8}),
        ("x IN (0, 1.5, NULL)", {2, 3, 7}), ("x NOT IN (0, NULL)", set()), ("x BETWEEN -3 AND 0", {2, 3, 8}), ("x NOT BETWEEN -3 AND 0", {1, 4, 5, 7}), ("x IS NULL", {6}), ("x IS NOT NULL", {1, 2, 3, 4, 5, 7, 8}),
        ("x IS DISTINCT FROM 0", {1, 4, 5, 6, 7, 8}), ("x IS NOT DISTINCT FROM 0", {2, 3}), ("x IS NOT DISTINCT FROM NULL", {6}),
    ],
)
def test_double_predicates(small, predicate, ids):
    assert {r[0] for r in rows(small, f"FROM d |> WHERE {predicate} |> SELECT id")} == ids


def test_three_valued_logic(small):
    def lt(v):
        return None if v is None else v < 1

    def neg(x):
        return None if x is None else not x

    def conj(x, y):
        return False if x is False or y is False else None if x is None or y is None else True

    domain = list(itertools.product((None, 0, 1, 2), repeat=2))
    for text, model in [
        ("a < 1 AND b < 1", lambda a, b: conj(lt(a), lt(b))),
        ("NOT (a < 1 AND b < 1)", lambda a, b: neg(conj(lt(a), lt(b)))),
        ("a < 1 OR b < 1", lambda a, b: neg(conj(neg(lt(a)), neg(lt(b))))),
        ("NOT (a < 1 OR NOT b < 1)", lambda a, b: conj(neg(lt(a)), lt(b))),
    ]:
        same(rows(small, f"FROM n |> WHERE {text}"), [(a, b) for a, b in domain if model(a, b) is True])


def test_order_places_nan_below_and_keeps_bits(small):
    found = rows(small, "FROM d |> ORDER BY x, id |> SELECT x, id")
    assert [r[1] for r in found] == [6, 1, 5, 8, 2, 3, 7, 4]
    assert [bits(r[0]) for r in found][4:6] == ["8000000000000000", "0000000000000000"]
    assert [r[0] for r in rows(small, "FROM d |> ORDER BY x DESC NULLS FIRST, id |> SELECT id")] == [6, 4, 7, 2, 3, 8, 5, 1]


def test_grouping_and_distinct_join_nan_and_zeros(spark):
    e = engine(spark, t=("x DOUBLE, v INT64", [(NAN, 1), (NAN, 2), (-0.0, 3), (-0.0, 4), (None, 5), (None, 6), (1.0, 7)]))
    found = rows(e, "FROM t |> AGGREGATE SUM(v) AS s GROUP AND ORDER BY x")
    assert [r[1] for r in found] == [11, 3, 7, 7]
    assert bits(found[2][0]) == "8000000000000000"
    assert len(rows(e, "FROM t |> SELECT x |> DISTINCT")) == 4
    assert [bits(r[0]) for r in rows(e, "FROM t |> SELECT x |> WHERE x = 0 |> EXCEPT ALL (FROM t |> WHERE v = 3 |> SELECT x)")] == ["8000000000000000"]


@pytest.mark.parametrize("kind", ["UNION", "EXCEPT", "INTERSECT"])
@pytest.mark.parametrize("every", ["ALL", "DISTINCT"])
def test_set_operations_against_counts(spark, kind, every):
    left = [(1, "a")] * 3 + [(2, None)] * 2 + [(None, "c")] + [(4, "d")]
    right = [(1, "a")] + [(2, None)] * 4 + [(5, "e")] * 2
    e = engine(spark, l=("a INT64, b STRING", left), r=("a INT64, b STRING", right))
    m, n = Counter(left), Counter(right)
    union = m + n if every == "ALL" else Counter(set(m) | set(n))
    exc = m - n if every == "ALL" else Counter(set(m) - set(n))
    inter = m & n if every == "ALL" else Counter(set(m) & set(n))
    expected = {"UNION": union, "EXCEPT": exc, "INTERSECT": inter}[kind]
    assert Counter(rows(e, f"FROM l |> {kind} {every} (FROM r)")) == expected


def test_set_operation_types(small):
    with pytest.raises(E.BindError):
        small.prepare("FROM facts |> SELECT v |> UNION ALL (FROM d |> SELECT x)")
    with pytest.raises(E.BindError):
        small.prepare("FROM facts |> UNION ALL (FROM d |> SELECT id)")


@pytest.mark.parametrize(
    ("values", "total", "mean"),
    [
        ([BIG, BIG], E.ArithmeticOverflow, BIG), ([BIG, BIG, -BIG], BIG, BIG / 3), ([BIG, BIG, NAN], NAN, NAN), ([BIG, BIG, -INF], -INF, -INF), ([INF, -INF], NAN, NAN), ([None, None], None, None),
        ([1.5, None, 2.5], 4.0, 2.0), ([], None, None),
    ],
)
def test_double_sums(spark, values, total, mean):
    e = engine(spark, t=("x DOUBLE", [(v,) for v in values]))
    if total is E.ArithmeticOverflow:
        with pytest.raises(E.ArithmeticOverflow) as failure:
            rows(e, "FROM t |> AGGREGATE SUM(x) AS s")
        assert failure.value.span == (20, 26)
    else:
        same(rows(e, "FROM t |> AGGREGATE SUM(x) AS s"), [(total,)])
    found = rows(e, "FROM t |> AGGREGATE AVG(x) AS a")[0][0]
    assert found is None and mean is None or found == pytest.approx(mean, nan_ok=True, rel=1e-15)


def test_exact_integer_sums(spark):
    e = engine(spark, t=("g INT64, x INT64", [(1, MAX), (1, MAX), (1, MIN), (1, -5), (2, MAX), (2, 1), (3, MIN), (3, None), (4, None)]))
    same(rows(e, "FROM t |> WHERE g != 2 |> AGGREGATE SUM(x) AS s, AVG(x) AS a, COUNT(x) AS n GROUP BY g"), [(1, MAX - 6, (MAX - 6) / 4, 4), (3, MIN, float(MIN), 1), (4, None, None, 0)])
    with pytest.raises(E.ArithmeticOverflow):
        rows(e, "FROM t |> WHERE g = 2 |> AGGREGATE SUM(x) AS s GROUP BY g")
    # a later filter rejects the group whose sum nobody asks for
    assert rows(e, "FROM t |> AGGREGATE SUM(x) AS s, COUNT(*) AS n GROUP BY g |> WHERE n = 1 |> SELECT g, s") == [(4, None)]


def test_extrema(spark):
    e = engine(spark, t=("x DOUBLE", [(0.0,), (-0.0,), (None,)]), u=("x DOUBLE", [(1.0,), (NAN,), (INF,)]))
    assert [bits(v) for v in rows(e, "FROM t |> AGGREGATE MIN(x) AS lo, MAX(x) AS hi")[0]] == ["8000000000000000", "0000000000000000"]
    same(rows(e, "FROM u |> AGGREGATE MIN(x) AS lo, MAX(x) AS hi"), [(NAN, NAN)])


def test_integer_functions(small):
    found = {r[0]: r[1:] for r in rows(small, "FROM edge |> WHERE id != 1 |> SELECT id, DIV(i, 2), MOD(i, 3), ABS(i), SIGN(i), CAST(i AS DOUBLE)")}
    assert found == {2: (MAX // 2, 1, MAX, 1, float(MAX)), 3: (-3, -1, 7, -1, -7.0), 4: (0, 0, 0, 0, 0.0), 5: (None,) * 5}
    assert rows(small, "FROM edge |> WHERE id = 1 |> SELECT MOD(i, -1)") == [(0,)]


@pytest.mark.parametrize(
    ("expression", "error", "name"),
    [
        ("1 / (id - 4)", E.DivisionByZero, None), ("DIV(1, i)", E.DivisionByZero, None), ("MOD(1, i)", E.DivisionByZero, None), ("DIV(i, -1)", E.ArithmeticOverflow, None), ("ABS(i)", E.ArithmeticOverflow, None), ("-i", E.ArithmeticOverflow, None),
        ("i + 1", E.ArithmeticOverflow, None), ("SQRT(i)", E.ArithmeticDomain, "square root"), ("LN(i)", E.ArithmeticDomain, "natural logarithm"), ("LOG10(i)", E.ArithmeticDomain, "base-ten logarithm"), ("EXP(id * 1000)", E.ArithmeticOverflow, "exponentiation"),
        ("POW(i, -1)", E.ArithmeticDomain, "power"), ("POW(i, 0.5)", E.ArithmeticDomain, "power"), ("POW(i, 100)", E.ArithmeticOverflow, "power"), ("CAST(i AS DOUBLE) * 1e300", E.ArithmeticOverflow, None),
    ],
)
def test_failures(small, expression, error, name):
    text = f"FROM edge |> SELECT {expression} AS v"
    with pytest.raises(error) as failure:
        rows(small, text)
    assert failure.value.span == (20, 20 + len(expression))
    assert name is None or failure.value.operation == name
    with pytest.raises(error):
        list(small.prepare(text).batches())


def test_integer_overflow_names_its_expression(small):
    text = "FROM edge |> SELECT id * 2 AS a, (i + 1) * 2 - id AS b, -id AS c |> WHERE a = 4 |> SELECT b"
    with pytest.raises(E.ArithmeticOverflow) as failure:
        rows(small, text)
    assert text[slice(*failure.value.span)] == "(i + 1) * 2 - id"
    assert rows(small, "FROM edge |> WHERE id = 3 |> SELECT -(i - 1) * -i + 0, i * NULL") == [(56, None)]
    assert rows(small, "FROM edge |> WHERE id = 1 |> SELECT i + 0, i - 0, -9223372036854775807 - 1") == [(MIN, MIN, MIN)]


def test_double_functions(spark):
    e = engine(spark, t=("x DOUBLE", [(v,) for v in (-0.4, 0.4, -0.5, 2.5, -2.5, 0.49999999999999994, -0.0, 1e300, INF, NAN)]))
    found = [[bits(v) for v in r] for r in rows(e, "FROM t |> SELECT x, FLOOR(x), CEIL(x), ROUND(x), SIGN(x), ABS(x)")]
    b = lambda *xs: [bits(float(x)) for x in xs]
    expected = [
        b(-0.4, -1, -0.0, -0.0, -1, 0.4), b(0.4, 0, 1, 0, 1, 0.4), b(-0.5, -1, -0.0, -1, -1, 0.5), b(2.5, 2, 3, 3, 1, 2.5), b(-2.5, -3, -2, -3, -1, 2.5),
        b(0.49999999999999994, 0, 1, 0, 1, 0.49999999999999994), b(-0.0, -0.0, -0.0, -0.0, 0.0, 0.0), b(1e300, 1e300, 1e300, 1e300, 1, 1e300), b(INF, INF, INF, INF, 1, INF),
    ]
    assert found[:9] == expected and all(v == bits(NAN) for v in found[9])


def test_power_identities(spark):
    cases = [(NAN, 0.0, 1.0), (1.0, NAN, 1.0), (-1.0, INF, 1.0), (0.5, INF, 0.0), (0.5, -INF, INF), (2.0, -INF, 0.0), (-INF, 3.0, -INF), (-INF, -3.0, -0.0), (-0.0, 3.0, -0.0), (NAN, 2.0, NAN), (2.0, NAN, NAN), (-1.0, 9007199254740992.0, 1.0), (0.0, -INF, INF)]
    e = engine(spark, t=("x DOUBLE, y DOUBLE", [c[:2] for c in cases] + [(None, 0.0), (1.0, None)]))
    found = [bits(r[0]) for r in rows(e, "FROM t |> SELECT POW(x, y)")]
    assert found == [bits(c[2]) for c in cases] + [None, None]


def test_safe_divide_coalesce_nullif(spark):
    e = engine(spark, t=("a DOUBLE, b DOUBLE", [(1.0, 0.0), (1.0, -0.0), (1e308, 1e-10), (NAN, 0.0), (6.0, 3.0), (None, 1.0), (NAN, NAN), (0.0, -0.0)]))
    assert [r[0] for r in rows(e, "FROM t |> SELECT SAFE_DIVIDE(a, b)")][:6] == [None, None, None, None, 2.0, None]
    found = [r[0] for r in rows(e, "FROM t |> SELECT NULLIF(a, b)")]
    assert math.isnan(found[6]) and found[7] is None and found[4] == 6.0
    assert rows(e, "FROM t |> LIMIT 1 |> SELECT COALESCE(1, 1 / 0), COALESCE(NULL, 2)") == [(1.0, 2)]


def test_case(spark):
    e = engine(spark, t=("x DOUBLE, y DOUBLE", [(NAN, 1.0), (1.0, NAN), (1.0, 2.0), (None, 1.0)]))
    text = "FROM t |> SELECT CASE WHEN x < y THEN 1 WHEN x > y THEN 2 WHEN x = y THEN 3 WHEN x != y THEN 4 ELSE 5 END, CASE WHEN x IS NULL THEN 1 END"
    assert rows(e, text) == [(4, None), (4, None), (1, None), (5, 1)]


def test_text_and_dates(small):
    same(rows(small, "FROM t |> SELECT BYTE_LENGTH(s), CHAR_LENGTH(s), EXTRACT(YEAR FROM d)"), [(0, 0, 1), (2, 1, 9999), (None, None, None), (3, 3, 2000)])


def test_demand(spark):
    e = engine(spark, t=("x INT64", [(0,), (2,)]))
    assert rows(e, "FROM t |> EXTEND 1 / x AS y |> WHERE x != 0 |> SELECT y") == [(0.5,)]
    assert rows(e, "FROM t |> EXTEND 1 / x AS y |> SELECT x |> ORDER BY x") == [(0,), (2,)]
    assert rows(e, "FROM t |> WHERE x > 5 |> SELECT 1 / 0") == []


def test_windows(spark):
    days = [("n", 1, 10), ("n", 1, 20), ("n", 2, None), ("n", 3, 5), ("s", 1, None), (None, 1, 7), (None, 2, 8)]
    e = engine(spark, t=("r STRING, d INT64, v INT64", days))
    found = rows(e, "FROM t |> EXTEND SUM(v) OVER (PARTITION BY r ORDER BY d) AS s |> EXTEND COUNT(*) OVER (PARTITION BY r) AS n")
    model = [(r, d, v, sum(w for r2, d2, w in days if r2 == r and d2 <= d and w is not None) if any(r2 == r and d2 <= d and w is not None for r2, d2, w in days) else None, sum(r2 == r for r2, _, _ in days)) for r, d, v in days]
    same(found, model)
    whole = rows(e, "FROM t |> EXTEND SUM(v) OVER (ORDER BY d DESC) AS s")
    same(whole, [(r, d, v, (lambda ws: sum(ws) if ws else None)([w for _, d2, w in days if d2 >= d and w is not None])) for r, d, v in days])
    e = engine(spark, t=("d INT64, v INT64", [(1, MAX), (2, 1), (3, -5)]))
    assert rows(e, "FROM t |> EXTEND SUM(v) OVER (ORDER BY d) AS s |> WHERE d != 2 |> SELECT d, s |> ORDER BY d") == [(1, MAX), (3, MAX - 4)]
    with pytest.raises(E.ArithmeticOverflow):
        rows(e, "FROM t |> EXTEND SUM(v) OVER (ORDER BY d) AS s")


def running(rows_, key):
    """Model of SUM(v) OVER (ORDER BY ...) with peers; ``key`` gives an ascending order."""
    total: dict = {}
    for r in rows_:
        total.setdefault(key(r), []).append(r[-1])
    found, sums = {}, []
    for k in sorted(total):
        sums += [v for v in total[k] if v is not None]
        found[k] = sum(sums) if sums else None
    return [(*r, found[key(r)]) for r in rows_]


def test_running_sums_over_ranges(spark, monkeypatch):
    """Hot text prefixes, an outlier, a key with a third of all rows, several keys, nulls in either place."""
    rng = random.Random(5)
    data = [("Customer#%09d" % rng.randrange(3000) if k % 3 else "hot", 10**18 if k == 7 else rng.randrange(50) if k % 11 else None, rng.randrange(-99, 99) if k % 13 else None) for k in range(4000)]
    e = engine(spark, t=("s STRING, n INT64, v INT64", data))
    for order, key in (
        ("s", lambda r: r[0]), ("n", lambda r: (r[1] is not None, r[1] or 0)), ("n DESC", lambda r: (r[1] is None, -(r[1] or 0))), ("n DESC NULLS FIRST, s", lambda r: (r[1] is not None, -(r[1] or 0), r[0])),
        ("n NULLS LAST, s, n DESC", lambda r: (r[1] is None, r[1] or 0, r[0])), ("v", lambda r: (r[2] is not None, r[2] or 0)),
    ):
        same(rows(e, f"FROM t |> EXTEND SUM(v) OVER (ORDER BY {order}) AS total"), running(data, key))
    plan = e.prepare("FROM t |> EXTEND SUM(v) OVER (ORDER BY s) AS total").dataframe()._jdf.queryExecution().analyzed().toString()
    assert "part__" in plan
    monkeypatch.setattr(windows, "RANGES", 8)
    monkeypatch.setattr(windows, "STEP", 3)
    same(rows(e, "FROM t |> EXTEND SUM(v) OVER (ORDER BY s DESC) AS total"), running(data, lambda r: tuple(-ord(c) for c in r[0]) + (1,)))
    empty = engine(spark, t=("s STRING, v INT64", []))
    assert rows(empty, "FROM t |> EXTEND SUM(v) OVER (ORDER BY s) AS total") == []


def test_ranges_are_balanced(spark):
    """Keys that share a long prefix, and one far away, still fall into many ranges."""
    e = engine(spark, t=("s STRING, n INT64, v INT64", [(f"Customer#00000{k:05d}", 10**18 if k == 3 else k, 1) for k in range(5000)]))
    for order in ("s", "n"):
        df = e.query(f"FROM t |> EXTEND SUM(v) OVER (ORDER BY {order}) AS total")
        assert df.count() == 5000 and df.agg({"total": "max"}).first()[0] == 5000


def test_many_copies_of_one_row(spark):
    """Set operations count copies and make them in chunks."""
    e = Engine(spark)
    e.register("a", spark.range(3_000_000).selectExpr("0L AS x"))
    e.register("b", spark.range(2_900_000).selectExpr("0L AS x"))
    assert rows(e, "FROM a |> EXCEPT ALL (FROM b) |> AGGREGATE COUNT(*) AS n") == [(100_000,)]
    assert rows(e, "FROM a |> INTERSECT ALL (FROM b) |> AGGREGATE COUNT(*) AS n") == [(2_900_000,)]
    counted = spark.createDataFrame([(1, 10_000_000), (2, 3), (3, 65_536), (4, 65_537)], "x long, copies__ long")
    found = {r[0]: r[1] for r in relational.replicated(counted, counted, ["x"]).groupBy("x").count().collect()}
    assert found == {1: 10_000_000, 2: 3, 3: 65_536, 4: 65_537}
    tasks = relational.replicated(counted.where("x = 1"), counted.where("x = 1"), ["x"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 10_000_000


def test_failures_beside_null_and_nan(spark):
    """What stands right of a NULL is evaluated, and an overflow fails whatever else the expression holds."""
    e = Engine(spark)
    e.register("t", spark.range(1).selectExpr("nullif(id, 0L) AS n", "id AS z", f"id + {MAX}L AS i", "id + 1e308D AS big", "id + CAST('NaN' AS DOUBLE) AS nan", "CAST(nullif(id, 0L) AS DOUBLE) AS nd"))
    for expression in ("n + DIV(1, z)", "n + 1 / z", "DIV(n, DIV(1, z))", "MOD(n, DIV(1, z))", "nd / (1 / z)", "POW(nd, 1 / z)", "NULLIF(n, DIV(1, z))", "SAFE_DIVIDE(nd, 1 / z)", "n * 2 + DIV(1, z) - 1", "CASE WHEN n < DIV(1, z) THEN 1 ELSE 2 END"):
        with pytest.raises(E.DivisionByZero):
            rows(e, f"FROM t |> SELECT {expression} AS y")
    for expression in ("big * 10 + nan", "nan + big * 10", "nd + big * 10", "big * 10 * nd", "(i + 1) + n", "n + (i + 1)", "n * (i * 2)", "-(i + 1) + n"):
        with pytest.raises(E.ArithmeticOverflow):
            rows(e, f"FROM t |> SELECT {expression} AS y")
    assert rows(e, "FROM t |> SELECT n + 1 + z, nan + big * 1 - big, COALESCE(1, DIV(1, z)), CASE WHEN n < 1 THEN 1 ELSE 2 END, n + DIV(4, z + 2), nd * big")[0][2:4] == (1, 2)


def test_deep_expressions_stay_short(spark):
    """Text grows with the depth of an expression, not with its power; failures come from every depth."""
    e = engine(spark, t=("x DOUBLE, i INT64", [(2.0, 3), (None, 4), (9.0, None)]))
    e.strict = False
    deep, whole = "x", "i"
    for k in range(12):
        deep, whole = f"SQRT(POW({deep} + 1, 2) / (ABS(x) + {k + 1}))", f"(DIV({whole} * 2 + i, 2) - MOD(i, 2))"
    model_x, model_i = [], []
    for x, i in ((2.0, 3), (None, 4), (9.0, None)):
        y, z = x, i
        for k in range(12):
            y = None if x is None else math.sqrt((y + 1) ** 2 / (abs(x) + k + 1))
            z = None if i is None else (z * 2 + i) // 2 - i % 2
        model_x.append(y)
        model_i.append(z)
    found = rows(e, f"FROM t |> SELECT {deep} AS a, {whole} AS b")
    assert [b for _, b in found] == model_i and all(a == m or a == pytest.approx(m) for (a, _), m in zip(found, model_x, strict=True))
    with pytest.raises(E.DivisionByZero):
        rows(e, f"FROM t |> SELECT {whole.replace('(DIV(i * 2', '(DIV(DIV(i, i - 3) * 2')} AS b")
    chain = " + ".join(["x"] * 40)
    assert rows(e, f"FROM t |> SELECT {chain} AS a |> WHERE a > 100") == [(360.0,)]


def test_limits_beyond_32_bits(spark):
    e = engine(spark, t=("x INT64", [(k,) for k in range(20)]))
    assert rows(e, f"FROM t |> LIMIT 5 OFFSET {2**31}") == []
    assert len(rows(e, f"FROM t |> LIMIT {2**31} OFFSET 3")) == 17
    assert rows(e, f"FROM t |> ORDER BY x DESC |> LIMIT {2**40} OFFSET 18") == [(1,), (0,)]
    assert len(rows(e, f"FROM t |> LIMIT {MAX} OFFSET {MAX}")) == 0 and len(rows(e, f"FROM t |> LIMIT {MAX}")) == 20


def test_names_and_ranges(small):
    same(rows(small, "FROM facts AS s |> SET v = v + 1 |> DROP k |> SELECT s.k, s.v AS old, v AS adjusted"), [(1, 10, 11), (1, 20, 21), (2, 30, 31), (None, 40, 41)])
    p = small.prepare("FROM facts |> RENAME k AS v, v AS k |> SELECT k, (v), +k, k + 1")
    assert [c[0] for c in p.columns] == ["k", "v", None, None]
    for bad in [
        "FROM facts |> SELECT v AS x, x", "FROM facts |> SELECT nope", "FROM nope", "FROM facts |> EXTEND v AS v |> SELECT v", "FROM facts |> DROP k, v", "FROM facts |> DROP k, k", "FROM facts |> RENAME facts AS x",
        "FROM facts |> SELECT k |> WHERE facts.k = 1", "FROM facts |> JOIN facts ON k = k", "FROM facts AS a |> JOIN dims AS b ON a.k = b.label", "FROM facts |> AGGREGATE COUNT(*) AS n GROUP BY k, k", "FROM facts |> WHERE k = 'x'",
        "FROM t |> SELECT s + 1", "FROM t |> AGGREGATE SUM(s) AS x", "FROM d |> EXTEND SUM(x) OVER (ORDER BY id)", "FROM d |> EXTEND COUNT(*) OVER (PARTITION BY x)", "FROM facts |> ORDER BY 3", "FROM d |> SELECT DIV(x, 2)",
    ]:
        with pytest.raises(E.BindError):
            small.prepare(bad)


def test_nullability(small):
    p = small.prepare("FROM facts |> SELECT v, k, v + k AS a, COALESCE(k, 1) AS b, NULLIF(v, 1) AS c, SAFE_DIVIDE(v, 1) AS d, CASE WHEN v = 1 THEN 1 END AS e, CASE WHEN k = 1 THEN 1 ELSE 2 END AS f")
    assert [c[2] for c in p.columns] == [False, True, True, False, True, True, True, False]
    assert [c[2] for c in small.prepare("FROM facts |> SELECT v |> INTERSECT ALL (FROM facts |> SELECT k)").columns] == [False]


def test_limits(small):
    with pytest.raises(E.BindError):
        small.prepare("FROM facts " + "|> WHERE v > 0 " * 17)
    with pytest.raises(E.ParseError):
        small.prepare("FROM facts |> SELECT " + ", ".join(["v"] * 100))
    with pytest.raises(E.BindError):
        small.prepare("FROM facts |> AGGREGATE " + ", ".join(f"COUNT(*) AS n{k}" for k in range(11)))


def test_limit_semantics(spark):
    e = engine(spark, t=("x INT64", [(k,) for k in range(20)]))
    assert rows(e, "FROM t |> ORDER BY x |> LIMIT 5 OFFSET 3 |> WHERE x > 5") == [(6,), (7,)]
    assert rows(e, "FROM t |> ORDER BY x DESC |> WHERE x != 19 |> EXTEND x + 1 AS y |> SELECT y |> LIMIT 2") == [(19,), (18,)]
    assert rows(e, "FROM t |> LIMIT 0") == []
    assert len(rows(e, f"FROM t |> LIMIT {MAX} OFFSET 4")) == 16


def test_explain(small):
    text = small.prepare("FROM facts AS f |> WHERE v > 1 |> JOIN dims AS d ON f.k = d.k |> AGGREGATE SUM(f.v) AS s GROUP AND ORDER BY d.label |> LIMIT 2").logical_plan()
    assert "r0 = source table=facts columns=[c1, c2]" in text and "inner-join left=r1 right=r2 on=c1 = c3" in text and "limit" in text and text.rstrip().endswith("order=[c5 ASC NULLS FIRST]")


def test_batches(spark):
    e = engine(spark, t=("x INT64", [(k,) for k in range(600)]))
    assert [len(b) for b in e.prepare("FROM t |> ORDER BY x").batches()] == [256, 256, 88]
