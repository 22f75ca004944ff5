"""Registered queries of sources, sinks and results: tables go through a scratch database or a file and come back.

Each writes whole tables of the driver below the session's shared folder, reads
them back through the engine, and has SQL for the rows that must result.
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import struct
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .cli import main
from .engine import Engine, Step, Token
from .sources.catalog import Catalog
from .sources.csv import CsvDecoder, import_csv_file
from .sources.jsonl import export_jsonl
from .sources.lineitem import load_lineitem
from .sources.parquet import export_parquet, import_parquet
from .sources.store import opened, scratch

ORDERS = [("o_orderkey", "INT64", False), ("o_orderstatus", "STRING", True), ("o_totalprice", "DOUBLE", True), ("o_orderdate", "DATE", True)]
CUSTOMERS = [("c_custkey", "INT64", False), ("c_name", "STRING", True), ("c_acctbal", "DOUBLE", True), ("c_mktsegment", "STRING", True)]
TURNS = [("conv_id", "INT64", False), ("turn", "INT64", False), ("role", "STRING", True), ("text", "STRING", True)]
NATIONS = [("n_nationkey", "INT64", False), ("n_name", "STRING", True), ("n_regionkey", "INT64", True)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))


def database(spark: SparkSession, **tables: list) -> Catalog:
    catalog = Catalog.create(spark, scratch(spark))
    for name, columns in tables.items():
        catalog.declare_table(name, columns)
    return catalog


def put(catalog: Catalog, table: str, df: DataFrame) -> str:
    append = catalog.begin_append(table)
    append.write_dataframe(df)
    append.commit()
    return append.token


def csv_lines(df: DataFrame) -> DataFrame:
    r"""CSV lines of text and numbers: text quoted, NULL as \N."""

    def field(name: str, kind: str) -> Column:
        text = F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(name).cast("string")
        return F.coalesce(text, F.lit(r"\N"))

    return df.select(F.concat_ws(",", *(field(n, k) for n, k in df.dtypes)).alias("value"))


def csv_file(df: DataFrame) -> str:
    """One CSV file in the shared folder: its path."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    header = spark.createDataFrame([(",".join(df.columns),)], "value string")
    # one file by contract of the format: a header, then the rows
    header.union(csv_lines(df)).coalesce(1).write.text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return next(f for f in files if Path(f).name.startswith("part-"))


def append_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = database(spark, t=ORDERS)
    put(catalog, "t", orders(spark, sf_dir))
    return Engine(spark, catalog).query("FROM t |> WHERE o_orderdate >= DATE '1996-01-01' |> SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate")


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = database(spark, t=NATIONS)
    append = catalog.begin_append("t")
    append.write(tuple(r) for r in read(spark, sf_dir, "nation").collect())  # 25 rows at every scale
    append.commit()
    return Engine(spark, catalog).query("FROM t |> SELECT n_nationkey, n_name, n_regionkey")


def append_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that was prepared before an append doesn't see its rows."""
    catalog, found = database(spark, t=ORDERS), orders(spark, sf_dir)
    engine = Engine(spark, catalog)
    put(catalog, "t", found.where("o_orderstatus = 'F'"))
    before = engine.prepare("FROM t |> AGGREGATE COUNT(*) AS n |> SELECT 1 AS generation, n")
    put(catalog, "t", found.where("o_orderstatus != 'F'"))
    return before.dataframe().union(engine.query("FROM t |> AGGREGATE COUNT(*) AS n |> SELECT 2 AS generation, n"))


def append_open_and_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleanup is refused while an append is open, takes an aborted append's files and loses no row."""
    catalog, found = database(spark, t=ORDERS), orders(spark, sf_dir)
    lost = catalog.begin_append("t")
    lost.write_dataframe(found)
    append = catalog.begin_append("t")
    append.write_dataframe(found)
    refused = 0
    try:
        catalog.reclaim()
    except E.Contention:
        refused = 1
    lost.abort()
    append.commit()
    catalog.reclaim()
    return Engine(spark, catalog).query("FROM t |> AGGREGATE COUNT(*) AS n, SUM(o_orderkey) AS keys").select(F.lit(refused).cast("long").alias("refused"), "n", "keys")


def declare_and_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = database(spark, Sales=ORDERS).inspect_table("SALES")
    rows = [(schema.name, schema.generation, k, name, kind, nullable) for k, (name, kind, nullable) in enumerate(schema.columns)]
    return spark.createDataFrame(rows, "name string, generation long, place long, column_name string, kind string, nullable boolean")


def resolve_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = database(spark, t=NATIONS)
    append = catalog.begin_append("t")
    append.write_dataframe(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")))
    before = catalog.resolve(append.token)
    append.commit()
    return spark.createDataFrame([("before", before), ("after", catalog.resolve(append.token)), ("unknown", catalog.resolve("0" * 32))], "asked string, generation long")


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = database(spark, t=CUSTOMERS)
    import_csv_file(catalog, "t", csv_file(read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", "c_name")))
    return Engine(spark, catalog).query("FROM t |> SELECT c_custkey, c_name, c_acctbal, c_mktsegment")


def csv_import_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with quotes and line ends inside quotes."""
    catalog = database(spark, t=TURNS)
    import_csv_file(catalog, "t", csv_file(read(spark, sf_dir, "conversations").select(*(n for n, _, _ in TURNS))))
    return Engine(spark, catalog).query("FROM t |> EXTEND BYTE_LENGTH(text) AS size |> SELECT conv_id, turn, role, text, size")


def csv_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a decoder over a stream."""
    rows = []
    with opened(spark, csv_file(read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey"))) as stream:
        decoder = CsvDecoder(stream, NATIONS, 7)
        number = 0
        while batch := decoder.next_batch():
            rows += [(number, *row) for row in batch]
            number += 1
    return spark.createDataFrame(rows, "batch long, n_nationkey long, n_name string, n_regionkey long")


def parquet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, folder = database(spark, t=ORDERS), scratch(spark)
    orders(spark, sf_dir).write.parquet(folder)
    import_parquet(catalog, "t", folder)
    return Engine(spark, catalog).query("FROM t |> SELECT o_orderkey, o_orderdate, o_totalprice")


def parquet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = Engine(spark), scratch(spark)
    engine.register("orders", read(spark, sf_dir, "orders"), ("o_orderdate",))
    export_parquet(engine.prepare("FROM orders |> WHERE o_totalprice < 200000 |> SELECT o_orderkey, o_orderdate, o_totalprice * 2 AS double_price"), folder)
    return spark.read.parquet(folder)


def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export's rows, read back: numbers as decimal text, doubles by their bits."""
    engine, out = Engine(spark), io.StringIO()
    engine.register("orders", read(spark, sf_dir, "orders"), ("o_orderdate",))
    export_jsonl(engine.prepare("FROM orders |> AGGREGATE COUNT(*) AS n, MAX(o_totalprice) AS top, MIN(o_orderdate) AS first GROUP BY o_orderstatus"), out)
    records = [json.loads(line) for line in out.getvalue().splitlines()]
    assert records[0]["columns"][0]["name"] == "o_orderstatus" and records[-1] == {"complete": True, "rows": len(records) - 2}
    rows = [(s, int(n), struct.unpack(">d", bytes.fromhex(top))[0], first) for s, n, top, first in (r["row"] for r in records[1:-1])]
    return spark.createDataFrame(rows, "o_orderstatus string, n long, top double, first_day string")


def lineitem_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited lines through the loader of ``lineitem``."""
    folder = scratch(spark)
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    fields = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *map(money, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")]
    rest = [F.lit(x) for x in ("1998-01-01", "1998-01-02", "NONE", "MAIL", "comment", "")]
    read(spark, sf_dir, "lineitem").select(F.concat_ws("|", *fields, *rest).alias("value")).write.text(folder)
    catalog = Catalog.create(spark, scratch(spark))
    load_lineitem(catalog, folder)
    return Engine(spark, catalog).query("FROM lineitem |> WHERE l_shipdate >= DATE '1995-01-01' |> SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


def result_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor stepped to its end: rows of every batch and the last state."""
    engine = Engine(spark)
    engine.register("customer", read(spark, sf_dir, "customer"))
    cursor = engine.prepare("FROM customer |> SELECT c_custkey, c_acctbal |> ORDER BY c_custkey").cursor(size=1000)
    sizes: list[int] = []
    kind = Step.PROGRESS
    while kind in (Step.PROGRESS, Step.ROWS):
        kind, found = cursor.step()
        if kind is Step.ROWS:
            sizes.append(len(found))
    return spark.createDataFrame([(k, n, kind.value) for k, n in enumerate(sizes)], "batch long, n long, last string")


def cancelled_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cancelled run ends in failure, and the prepared query runs again with another token."""
    engine = Engine(spark)
    engine.register("customer", read(spark, sf_dir, "customer"))
    prepared, token = engine.prepare("FROM customer |> AGGREGATE COUNT(*) AS n"), Token()
    token.cancel()
    kind, error = prepared.cursor(token).step()
    ((n,),) = prepared.rows()
    return spark.createDataFrame([(kind.value, type(error).__name__, n)], "state string, error string, n long")


def refused_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are refused, with the kind and place of the failure."""
    engine = Engine(spark)
    engine.register("nation", read(spark, sf_dir, "nation"))
    rows = []
    for text in ("FROM nation |> WHERE n_regionkey = NULL", "FROM nation |> WHERE n_rgionkey = 1", "FROM nation |> WHERE n_name = 1", "FROM nations"):
        try:
            engine.prepare(text)
        except (E.ParseError, E.BindError) as e:
            rows.append((text, type(e).__name__, text.encode()[e.span.start : e.span.end].decode()))
    return spark.createDataFrame(rows, "text string, failure string, place string")


def explained_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("nation", read(spark, sf_dir, "nation"))
    plan = engine.prepare("FROM nation |> WHERE n_regionkey > 1 |> AGGREGATE COUNT(*) AS n GROUP AND ORDER BY n_regionkey |> LIMIT 2").logical_plan()
    stages = [(int(k), stage) for k, stage in re.findall(r"^r(\d+) = ([a-z-]+)", plan, re.MULTILINE)]
    return spark.createDataFrame(stages, "place long, stage string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, declare, import, query through the command line."""
    root = scratch(spark)
    given = csv_file(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    out = io.StringIO()
    with tempfile.TemporaryDirectory() as local, contextlib.redirect_stdout(out):  # files that the driver alone reads
        (Path(local) / "schema").write_text("table customer\nc_custkey int64 required\nc_mktsegment string nullable\n")
        (Path(local) / "query").write_text("FROM customer |> AGGREGATE COUNT(*) AS n, SUM(c_custkey) AS keys GROUP AND ORDER BY c_mktsegment")
        codes = [main([*args, "--database", root], spark) for args in (["create-declared"], ["declare", "--schema-file", f"{local}/schema"], ["import", "--table", "customer", "--input", given], ["query", "--query-file", f"{local}/query"], ["declare", "--schema-file", f"{local}/schema"])]
    rows = [line[4:].split("|") for line in out.getvalue().splitlines() if line.startswith("row=")]
    found = [(bytes.fromhex(s.split(":")[1]).decode(), int(n.split(":")[1]), int(k.split(":")[1]), ",".join(map(str, codes))) for s, n, k in rows]
    return spark.createDataFrame(found, "c_mktsegment string, n long, keys long, codes string")


def special(spark: SparkSession, sf_dir: str) -> Engine:
    """Orders whose price is NULL, NaN, -0.0, 0.0 or an infinity by the key's remainder."""
    k = F.col("o_orderkey") % 8
    x = F.when(k == 1, float("nan")).when(k == 2, F.lit(-0.0)).when(k == 3, F.lit(0.0)).when(k == 4, float("inf")).when(k == 5, float("-inf")).when(k > 5, F.floor(F.col("o_totalprice") / 1000).cast("double"))
    engine = Engine(spark)
    engine.register("special", read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), (F.col("o_orderkey") % 5).alias("g")))
    return engine


def _special(text: str):
    return lambda spark, sf_dir: special(spark, sf_dir).query(text)


#: The same rows in SQL.
_SPECIAL = """WITH special AS (SELECT o_orderkey, o_orderkey % 5 AS g, CASE o_orderkey % 8 WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN -0.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 'inf'::DOUBLE WHEN 5 THEN '-inf'::DOUBLE
  WHEN 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS x FROM orders) """

_ORDERS = "CAST(o_orderdate AS DATE)"

#: name -> (query, SQL)
PAIRS: dict = {
    "append_dataframe": (append_dataframe, f"SELECT o_orderkey, o_orderstatus, o_totalprice, {_ORDERS} AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-01-01'"),
    "append_rows": (append_rows, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "append_snapshots": (append_snapshots, "SELECT CAST(1 AS BIGINT) AS generation, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, count(*) FROM orders"),
    "append_open_and_reclaim": (append_open_and_reclaim, "SELECT CAST(1 AS BIGINT) AS refused, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders"),
    "declare_and_inspect": (
        declare_and_inspect,
        "SELECT 'Sales' AS name, CAST(1 AS BIGINT) AS generation, CAST(place AS BIGINT) AS place, column_name, kind, nullable FROM (VALUES (0, 'o_orderkey', 'INT64', false), (1, 'o_orderstatus', 'STRING', true), (2, 'o_totalprice', 'DOUBLE', true), (3, 'o_orderdate', 'DATE', true)) AS v(place, column_name, kind, nullable)",
    ),
    "resolve_commit": (resolve_commit, "SELECT asked, CAST(generation AS BIGINT) AS generation FROM (VALUES ('before', NULL), ('after', 2), ('unknown', NULL)) AS v(asked, generation)"),
    "csv_import": (csv_import, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"),
    "csv_import_quoted_lines": (csv_import_quoted_lines, "SELECT conv_id, turn, role, text, CAST(strlen(text) AS BIGINT) AS size FROM conversations"),
    "csv_decoder": (csv_decoder, "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS batch, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"),
    "parquet_import": (parquet_import, f"SELECT o_orderkey, {_ORDERS} AS o_orderdate, o_totalprice FROM orders"),
    "parquet_export": (parquet_export, f"SELECT o_orderkey, {_ORDERS} AS o_orderdate, o_totalprice * 2 AS double_price FROM orders WHERE o_totalprice < 200000"),
    "jsonl_export": (jsonl_export, f"SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top, CAST(min({_ORDERS}) AS VARCHAR) AS first_day FROM orders GROUP BY o_orderstatus"),
    "lineitem_load": (lineitem_load, "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE l_shipdate >= DATE '1995-01-01'"),
    "result_cursor": (result_cursor, "SELECT batch, count(*) AS n, 'finished' AS last FROM (SELECT (row_number() OVER () - 1) // 1000 AS batch FROM customer) GROUP BY batch"),
    "cancelled_result": (cancelled_result, "SELECT 'failed' AS state, 'Cancelled' AS error, count(*) AS n FROM customer"),
    "refused_comparison": (
        refused_comparison,
        "SELECT * FROM (VALUES ('FROM nation |> WHERE n_regionkey = NULL', 'ParseError', 'NULL'), ('FROM nation |> WHERE n_rgionkey = 1', 'BindError', 'n_rgionkey'), ('FROM nation |> WHERE n_name = 1', 'BindError', 'n_name = 1'), ('FROM nations', 'BindError', 'nations')) AS v(text, failure, place)",
    ),
    "explained_plan": (explained_plan, "SELECT CAST(place AS BIGINT) AS place, stage FROM (VALUES (0, 'source'), (1, 'filter'), (2, 'aggregate'), (3, 'limit')) AS v(place, stage)"),
    "command_line": (command_line, "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, '0,0,0,0,1' AS codes FROM customer GROUP BY c_mktsegment"),
    "special_filter": (_special("FROM special |> WHERE x < 100 OR x >= 400 |> SELECT o_orderkey"), _SPECIAL + "SELECT o_orderkey FROM special WHERE NOT isnan(x) AND (x < 100 OR x >= 400)"),
    "special_not_filter": (_special("FROM special |> WHERE NOT (x < 100) |> SELECT o_orderkey"), _SPECIAL + "SELECT o_orderkey FROM special WHERE isnan(x) OR x >= 100"),
    "special_distinct_from": (_special("FROM special |> WHERE x IS DISTINCT FROM 0 |> SELECT o_orderkey"), _SPECIAL + "SELECT o_orderkey FROM special WHERE x IS DISTINCT FROM 0"),
    "special_join": (_special("FROM special |> WHERE o_orderkey < 4000 |> SELECT o_orderkey AS a, x AS x |> JOIN (FROM special |> WHERE g = 1 AND o_orderkey < 800 |> SELECT o_orderkey AS b, x AS y) AS r ON x = r.y |> SELECT a, b"), _SPECIAL + "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM special a JOIN special b ON a.x = b.x AND NOT isnan(a.x) WHERE a.o_orderkey < 4000 AND b.g = 1 AND b.o_orderkey < 800"),
    "special_left_join": (
        _special("FROM special |> SELECT o_orderkey AS a, x AS x |> LEFT JOIN (FROM special |> AGGREGATE COUNT(*) AS n GROUP BY x |> SELECT x AS y, n) AS r ON x = r.y |> SELECT a, r.n AS n"),
        _SPECIAL + "SELECT a.o_orderkey AS a, n FROM special a LEFT JOIN (SELECT x, count(*) AS n FROM special GROUP BY x) b ON a.x = b.x AND NOT isnan(a.x)",
    ),
    "special_group": (_special("FROM special |> AGGREGATE COUNT(*) AS n, COUNT(x) AS present, SUM(o_orderkey) AS keys GROUP BY x |> SELECT n, present, keys"), _SPECIAL + "SELECT count(*) AS n, count(x) AS present, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM special GROUP BY x"),
    "special_order": (
        _special("FROM special |> ORDER BY x ASC NULLS FIRST, o_orderkey |> LIMIT 400 OFFSET 100 |> SELECT o_orderkey"),
        _SPECIAL + "SELECT o_orderkey FROM special ORDER BY CASE WHEN x IS NULL THEN 0 WHEN isnan(x) THEN 1 ELSE 2 END, CASE WHEN isnan(x) THEN NULL ELSE x END, o_orderkey LIMIT 400 OFFSET 100",
    ),
    "special_extrema": (
        _special("FROM special |> WHERE x IS NOT NULL |> EXTEND CASE WHEN x < 1000000 THEN x WHEN x > 1000000 THEN 5.0 ELSE NULL END AS y |> AGGREGATE MIN(y) AS low, MAX(y) AS high, COUNT(y) AS n GROUP BY g"),
        _SPECIAL + "SELECT g, min(y) AS low, max(y) AS high, count(y) AS n FROM (SELECT g, CASE WHEN isnan(x) THEN NULL WHEN x < 1000000 THEN x WHEN x > 1000000 THEN 5.0 ELSE NULL END AS y FROM special WHERE x IS NOT NULL) GROUP BY g",
    ),
    "special_null_arithmetic": (
        _special("FROM special |> SELECT o_orderkey, NULLIF(g, 0) * 2 + NULLIF(g, 1) AS a, DIV(o_orderkey, NULLIF(g, 0)) AS b, COALESCE(NULLIF(g, 0), -1) AS c, CASE WHEN x < 0 THEN 1 WHEN x > 0 THEN 2 WHEN x = 0 THEN 3 END AS d"),
        _SPECIAL + "SELECT o_orderkey, nullif(g, 0) * 2 + nullif(g, 1) AS a, o_orderkey // nullif(g, 0) AS b, coalesce(nullif(g, 0), -1) AS c, CASE WHEN isnan(x) THEN NULL WHEN x < 0 THEN 1 WHEN x > 0 THEN 2 WHEN x = 0 THEN 3 END::BIGINT AS d FROM special",
    ),
    "special_set_operations": (
        _special("FROM special |> WHERE g < 3 |> SELECT x |> EXCEPT ALL (FROM special |> WHERE g >= 3 |> SELECT x) |> AGGREGATE COUNT(*) AS n, COUNT(x) AS present"),
        _SPECIAL + "SELECT CAST(sum(greatest(l - r, 0)) AS BIGINT) AS n, CAST(sum(greatest(l - r, 0)) FILTER (x IS NOT NULL) AS BIGINT) AS present FROM (SELECT x, count(*) FILTER (g < 3) AS l, count(*) FILTER (g >= 3) AS r FROM special GROUP BY x)",
    ),
    "special_window": (
        _special("FROM special |> EXTEND NULLIF(g, 2) AS v, NULLIF(g, 3) AS k |> EXTEND SUM(v) OVER (ORDER BY k DESC NULLS FIRST) AS s |> EXTEND COUNT(*) OVER (PARTITION BY k) AS n |> SELECT o_orderkey, s, n"),
        _SPECIAL + "SELECT o_orderkey, CAST(sum(v) OVER (ORDER BY k DESC NULLS FIRST) AS BIGINT) AS s, count(*) OVER (PARTITION BY k) AS n FROM (SELECT o_orderkey, nullif(g, 2) AS v, nullif(g, 3) AS k FROM special)",
    ),
    "window_placement": (
        lambda spark, sf_dir: _customers(spark, sf_dir).query("FROM customer |> WHERE c_acctbal > 0 |> EXTEND SUM(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS s |> WHERE s > 20000 |> SELECT c_custkey, s, COUNT(*) OVER () AS n"),
        "SELECT c_custkey, s, count(*) OVER () AS n FROM (SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS BIGINT) AS s FROM customer WHERE c_acctbal > 0) WHERE s > 20000",
    ),
    # a window ends the order before it, so the order that LIMIT takes stands after it
    "window_clears_order": (
        lambda spark, sf_dir: _customers(spark, sf_dir).query("FROM customer |> ORDER BY c_name |> EXTEND COUNT(*) OVER (PARTITION BY c_mktsegment) AS n |> ORDER BY c_acctbal DESC, c_custkey |> LIMIT 50 |> SELECT c_custkey, n"),
        "SELECT c_custkey, n FROM (SELECT c_custkey, c_acctbal, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    ),
}


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    engine.register("customer", read(spark, sf_dir, "customer"))
    return engine


def queries() -> dict:
    return {name: query for name, (query, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS.items()}
