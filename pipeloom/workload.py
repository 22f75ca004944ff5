"""Registered queries of the engine: pipe text over the driver's tables, and equivalent SQL.

Every query reads whole tables.  DOUBLE sums are rounded in both texts, since their
last bits depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Timestamps that are midnights: dates to the engine.
DATES = ("l_shipdate", "o_orderdate")

_D = "CAST(o_orderdate AS DATE)"
_L = "CAST(l_shipdate AS DATE)"

#: name -> (pipe query, SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "scan_project": ("FROM orders |> SELECT o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders"),
    "scan_alias_qualified": ("FROM orders AS o |> SELECT o.o_orderkey AS k, o.o_orderdate AS d", f"SELECT o_orderkey AS k, {_D} AS d FROM orders"),
    "child_source": ("FROM (FROM orders |> WHERE o_totalprice > 300000 |> SELECT o_orderkey AS k, o_custkey AS c) AS t |> SELECT t.c, t.k", "SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_totalprice > 300000"),
    "filter_compare": ("FROM lineitem |> WHERE l_quantity < 25 AND l_shipdate >= DATE '1996-01-01' |> SELECT l_orderkey, l_linenumber", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity < 25 AND l_shipdate >= DATE '1996-01-01'"),
    "filter_date": ("FROM orders |> WHERE o_orderdate != DATE '1996-02-29' AND o_orderdate <= DATE_SUB(DATE '1997-03-31', INTERVAL 1 MONTH) |> SELECT o_orderkey, o_orderdate", f"SELECT o_orderkey, {_D} AS o_orderdate FROM orders WHERE {_D} <> DATE '1996-02-29' AND {_D} <= DATE '1997-02-28'"),
    "filter_text": ("FROM customer |> WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < \"F\" |> SELECT c_custkey, c_mktsegment", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'F'"),
    "filter_in": ("FROM orders |> WHERE o_orderstatus IN ('F', 'O') |> SELECT o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "filter_in_null": ("FROM nation |> WHERE n_regionkey IN (1, 3, NULL) |> SELECT n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey IN (1, 3, NULL)"),
    "filter_not_in_null": ("FROM nation |> WHERE n_regionkey NOT IN (1, NULL) |> SELECT n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey NOT IN (1, NULL)"),
    "filter_between": ("FROM lineitem |> WHERE l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 |> SELECT l_orderkey, l_discount", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= CAST(0.06 AS DOUBLE) - CAST(0.01 AS DOUBLE) AND l_discount <= CAST(0.06 AS DOUBLE) + CAST(0.01 AS DOUBLE)"),
    "filter_not_between": ("FROM part |> WHERE p_size NOT BETWEEN 5 AND 45 |> SELECT p_partkey, p_size", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45"),
    "filter_is_null": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> WHERE l.quality IS NULL |> SELECT documents.doc_id AS doc_id", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL"),
    "filter_is_not_null": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> WHERE l.quality IS NOT NULL |> SELECT documents.doc_id AS doc_id, l.quality AS quality", "SELECT d.doc_id, CAST(quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"),
    "filter_is_distinct": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> WHERE l.quality IS DISTINCT FROM 1 |> SELECT documents.doc_id AS doc_id, l.quality AS quality", "SELECT d.doc_id, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1"),
    "filter_is_not_distinct": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> WHERE l.toxic IS NOT DISTINCT FROM NULL |> SELECT documents.doc_id AS doc_id", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL"),
    "filter_bool_tree": ("FROM part |> WHERE NOT (p_size < 10 OR p_size > 40) AND (p_brand = 'Brand#11' OR NOT p_retailprice < 1500) |> SELECT p_partkey", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_size > 40) AND (p_brand = 'Brand#11' OR NOT p_retailprice < 1500)"),
    "tpch_q6": (
        "FROM lineitem |> WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE_ADD(DATE '1996-01-01', INTERVAL 1 YEAR) AND l_discount BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 25 |> AGGREGATE SUM(l_extendedprice * l_discount) AS total |> SELECT ROUND(total * 10) / 10 AS revenue",
        "SELECT round(sum(l_extendedprice * l_discount) * 10) / 10 AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount >= CAST(0.06 AS DOUBLE) - CAST(0.01 AS DOUBLE) AND l_discount <= CAST(0.06 AS DOUBLE) + CAST(0.01 AS DOUBLE) AND l_quantity < 25",
    ),
    "tpch_q1": (
        "FROM lineitem |> WHERE l_shipdate <= DATE_SUB(DATE '1998-12-01', INTERVAL 74 DAY) |> AGGREGATE SUM(l_quantity) AS q, SUM(l_extendedprice) AS p, SUM(l_extendedprice * (1 - l_discount)) AS d, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c, AVG(l_quantity) AS aq, AVG(l_extendedprice) AS ap, AVG(l_discount) AS ad, COUNT(*) AS count_order GROUP AND ORDER BY l_returnflag, l_linestatus"
        " |> SELECT l_returnflag, l_linestatus, ROUND(q) AS sum_qty, ROUND(p) AS sum_base_price, ROUND(d) AS sum_disc_price, ROUND(c) AS sum_charge, ROUND(aq * 1000) AS avg_qty, ROUND(ap * 10) AS avg_price, ROUND(ad * 100000) AS avg_disc, count_order",
        f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity)) AS sum_qty, round(sum(l_extendedprice)) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount))) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))) AS sum_charge, round(avg(l_quantity) * 1000) AS avg_qty, round(avg(l_extendedprice) * 10) AS avg_price, round(avg(l_discount) * 100000) AS avg_disc, count(*) AS count_order FROM lineitem WHERE {_L} <= DATE '1998-09-18' GROUP BY 1, 2 ORDER BY 1, 2",
    ),
    "extend": ("FROM part |> EXTEND p_size * 2 AS twice, p_retailprice / p_size AS each |> SELECT p_partkey, twice, each", "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS twice, p_retailprice / p_size AS each FROM part"),
    "set_columns": ("FROM customer |> SET c_acctbal = c_acctbal + 1, c_nationkey = c_nationkey * 10 |> SELECT c_custkey, c_nationkey, c_acctbal", "SELECT c_custkey, CAST(c_nationkey * 10 AS BIGINT) AS c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer"),
    "drop_columns": ("FROM supplier |> DROP s_name, s_acctbal", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"),
    "rename": ("FROM region |> RENAME r_name AS name", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name AS name FROM region"),
    "rename_swap": ("FROM nation |> RENAME n_nationkey AS n_regionkey, n_regionkey AS n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_regionkey, n_name, CAST(n_regionkey AS BIGINT) AS n_nationkey FROM nation"),
    "alias_stage": ("FROM nation |> WHERE n_regionkey = 2 |> AS t |> SELECT t.n_name", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "alias_range_old_value": ("FROM customer AS s |> SET c_acctbal = c_acctbal + 1 |> SELECT s.c_custkey, s.c_acctbal AS original, c_acctbal AS adjusted", "SELECT c_custkey, c_acctbal AS original, c_acctbal + 1 AS adjusted FROM customer"),
    "range_after_drop": ("FROM customer AS s |> DROP c_acctbal |> SELECT c_custkey, s.c_acctbal AS kept", "SELECT c_custkey, c_acctbal AS kept FROM customer"),
    "unary_plus": ("FROM part |> SELECT p_partkey, +p_size AS s, -p_size AS m", "SELECT p_partkey, CAST(p_size AS BIGINT) AS s, CAST(-p_size AS BIGINT) AS m FROM part"),
    "const_projection": ("FROM region |> SELECT r_regionkey, 'a\\tb' AS t, DATE '2024-02-29' AS d, 7 AS n, NULL AS z, BYTE_LENGTH('né') AS bytes, CHAR_LENGTH('né') AS chars", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, 'a' || chr(9) || 'b' AS t, DATE '2024-02-29' AS d, CAST(7 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS z, CAST(3 AS BIGINT) AS bytes, CAST(2 AS BIGINT) AS chars FROM region"),
    "order_limit_offset": ("FROM orders |> SELECT o_totalprice, o_orderkey |> ORDER BY 1 DESC, 2 |> LIMIT 10 OFFSET 5", "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 10 OFFSET 5"),
    "order_whole": ("FROM nation |> ORDER BY n_regionkey DESC, n_name |> SELECT n_regionkey, n_name", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2"),
    "order_desc_nulls": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> SELECT documents.doc_id AS d, l.quality AS q |> ORDER BY q DESC NULLS FIRST, d |> LIMIT 50", "SELECT d.doc_id AS d, CAST(l.quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q DESC NULLS FIRST, d LIMIT 50"),
    "order_hidden_key": ("FROM orders |> ORDER BY o_totalprice, o_orderkey |> SELECT o_orderkey |> LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20"),
    "limit_then_filter": ("FROM orders |> ORDER BY o_orderkey |> LIMIT 100 |> WHERE o_orderstatus = 'F' |> SELECT o_orderkey", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_orderstatus = 'F'"),
    "filter_then_limit": ("FROM orders |> ORDER BY o_orderkey DESC |> EXTEND o_orderkey * 2 AS k |> WHERE o_orderstatus = 'F' |> SELECT k |> LIMIT 30", "SELECT o_orderkey * 2 AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 30"),
    "join_inner": ("FROM orders |> JOIN customer AS c ON o_custkey = c.c_custkey |> SELECT o_orderkey, c.c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left": ("FROM customer |> LEFT OUTER JOIN orders AS o ON c_custkey = o.o_custkey |> SELECT c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_left_filter": ("FROM customer |> LEFT JOIN orders AS o ON c_custkey = o.o_custkey |> WHERE o.o_totalprice > 200000 |> SELECT c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000"),
    "join_self": ("FROM nation AS a |> JOIN nation AS b ON a.n_regionkey = b.n_regionkey |> SELECT a.n_nationkey AS x, b.n_nationkey AS y", "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.n_nationkey AS BIGINT) AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "join_child": ("FROM nation |> JOIN (FROM customer |> AGGREGATE COUNT(*) AS n GROUP BY c_nationkey) AS k ON n_nationkey = k.c_nationkey |> SELECT n_name, k.n", "SELECT n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey"),
    "join_three": ("FROM orders |> JOIN customer ON o_custkey = c_custkey |> JOIN nation ON c_nationkey = n_nationkey |> JOIN region ON n_regionkey = r_regionkey |> AGGREGATE COUNT(*) AS n GROUP BY r_name", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_text_key": ("FROM documents AS d |> JOIN (FROM documents |> AGGREGATE COUNT(*) AS n GROUP BY source) AS s ON d.source = s.source |> SELECT d.doc_id, s.n", "SELECT doc_id, n FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s ON d.source = s.source"),
    "join_double_key": ("FROM part AS p |> JOIN (FROM part |> AGGREGATE COUNT(*) AS n GROUP BY p_retailprice) AS q ON p.p_retailprice = q.p_retailprice |> SELECT p.p_partkey, q.n", "SELECT p_partkey, n FROM part p JOIN (SELECT p_retailprice, count(*) AS n FROM part GROUP BY 1) q ON p.p_retailprice = q.p_retailprice"),
    "agg_global": ("FROM orders |> AGGREGATE COUNT(*) AS n, SUM(o_orderkey) AS s, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi", f"SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, min({_D}) AS lo, max({_D}) AS hi FROM orders"),
    "agg_global_empty": ("FROM orders |> WHERE o_totalprice < 0 |> AGGREGATE COUNT(*) AS n, COUNT(o_orderkey) AS c, SUM(o_orderkey) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS m", "SELECT count(*) AS n, count(o_orderkey) AS c, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_totalprice) AS a, min(o_orderstatus) AS m FROM orders WHERE o_totalprice < 0"),
    "agg_grouped_empty": ("FROM orders |> WHERE o_totalprice < 0 |> AGGREGATE COUNT(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY 1"),
    "agg_ordered": ("FROM orders |> AGGREGATE COUNT(*) AS n GROUP AND ORDER BY o_orderpriority, o_orderstatus", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2"),
    "agg_repeat": ("FROM orders |> AGGREGATE COUNT(*) AS n GROUP BY o_custkey |> AGGREGATE COUNT(*) AS customers, MAX(n) AS most GROUP BY n", "SELECT n, count(*) AS customers, max(n) AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "agg_having": ("FROM orders |> AGGREGATE COUNT(*) AS n, SUM(o_orderkey) AS s GROUP BY o_custkey |> WHERE n > 15", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "agg_sum_int": ("FROM lineitem |> AGGREGATE SUM(l_orderkey * 1000) AS s GROUP BY l_returnflag |> SELECT l_returnflag, s", "SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    "agg_sum_double": ("FROM lineitem |> EXTEND ROUND(l_extendedprice * 100) AS cents |> AGGREGATE SUM(cents) AS s GROUP BY l_returnflag", "SELECT l_returnflag, sum(round(l_extendedprice * 100)) AS s FROM lineitem GROUP BY 1"),
    "agg_avg_int": ("FROM lineitem |> AGGREGATE AVG(l_linenumber) AS a GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(l_linenumber) AS DOUBLE) / count(l_linenumber) AS a FROM lineitem GROUP BY 1"),
    "agg_avg_double": ("FROM lineitem |> AGGREGATE AVG(l_quantity) AS a GROUP BY l_linestatus", "SELECT l_linestatus, sum(l_quantity) / count(l_quantity) AS a FROM lineitem GROUP BY 1"),
    "agg_count_expr": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> AGGREGATE COUNT(*) AS n, COUNT(l.quality) AS present, COUNT(NULLIF(l.quality, 0)) AS good GROUP BY lang", "SELECT lang, count(*) AS n, count(quality) AS present, count(nullif(quality, 0)) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "agg_min_max_text": ("FROM customer |> AGGREGATE MIN(c_name) AS lo, MAX(c_name) AS hi GROUP BY c_mktsegment", "SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1"),
    "agg_min_max_date": ("FROM lineitem |> AGGREGATE MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi GROUP BY l_returnflag", f"SELECT l_returnflag, min({_L}) AS lo, max({_L}) AS hi FROM lineitem GROUP BY 1"),
    "agg_min_max_num": ("FROM lineitem |> AGGREGATE MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, MIN(l_partkey) AS p GROUP BY l_suppkey", "SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_partkey) AS p FROM lineitem GROUP BY 1"),
    "agg_double_key": ("FROM lineitem |> AGGREGATE COUNT(*) AS n GROUP AND ORDER BY l_discount", "SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1"),
    "agg_date_key": ("FROM orders |> AGGREGATE COUNT(*) AS n GROUP BY o_orderdate", f"SELECT {_D} AS o_orderdate, count(*) AS n FROM orders GROUP BY 1"),
    "distinct": ("FROM lineitem |> SELECT l_returnflag, l_linestatus |> DISTINCT", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_double": ("FROM lineitem |> SELECT l_discount, l_tax |> DISTINCT", "SELECT DISTINCT l_discount, l_tax FROM lineitem"),
    "distinct_hidden": ("FROM nation AS s |> SELECT n_regionkey |> EXTEND n_regionkey + 1 AS r |> DISTINCT |> DROP n_regionkey", "SELECT r FROM (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS k, CAST(n_regionkey + 1 AS BIGINT) AS r FROM nation)"),
    "union_all": ("FROM customer |> SELECT c_nationkey AS k |> UNION ALL (FROM supplier |> SELECT s_nationkey)", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("FROM customer |> SELECT c_nationkey AS k |> UNION DISTINCT (FROM supplier |> SELECT s_nationkey)", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_chain": ("FROM region |> SELECT r_regionkey AS k |> UNION ALL (FROM nation |> SELECT n_regionkey), (FROM supplier |> SELECT s_nationkey),", "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT n_regionkey FROM nation UNION ALL SELECT s_nationkey FROM supplier"),
    "except_all": ("FROM customer |> SELECT c_nationkey AS k |> EXCEPT ALL (FROM supplier |> SELECT s_nationkey)", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "except_distinct": ("FROM nation |> SELECT n_nationkey AS k |> EXCEPT DISTINCT (FROM supplier |> SELECT s_nationkey)", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier"),
    "intersect_all": ("FROM customer |> SELECT c_nationkey AS k |> INTERSECT ALL (FROM supplier |> SELECT s_nationkey)", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "intersect_distinct": ("FROM lineitem |> SELECT l_discount AS d |> INTERSECT DISTINCT (FROM lineitem |> SELECT l_tax)", "SELECT l_discount AS d FROM lineitem INTERSECT SELECT l_tax FROM lineitem"),
    "setop_nested": ("FROM nation |> SELECT n_nationkey AS k |> EXCEPT DISTINCT (FROM supplier |> SELECT s_nationkey |> INTERSECT DISTINCT (FROM customer |> SELECT c_nationkey |> WHERE c_nationkey < 9)) |> ORDER BY k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation EXCEPT (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_nationkey < 9)"),
    "setop_branch_limit": ("FROM region |> SELECT r_regionkey AS k |> UNION ALL (FROM orders |> ORDER BY o_orderkey DESC |> LIMIT 3 |> SELECT o_orderkey)", "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT * FROM (SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 3)"),
    "window_count_all": ("FROM nation |> EXTEND COUNT(*) OVER () AS n |> SELECT n_name, n", "SELECT n_name, count(*) OVER () AS n FROM nation"),
    "window_count_part": ("FROM orders |> EXTEND COUNT(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n |> SELECT o_orderkey, n", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders"),
    "window_sum_peers": ("FROM lineitem |> EXTEND SUM(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS s |> SELECT l_orderkey, l_linenumber, s", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS BIGINT) AS s FROM lineitem"),
    "window_sum_noparts": ("FROM orders |> EXTEND SUM(o_custkey) OVER (ORDER BY o_orderdate DESC, o_orderpriority) AS s |> SELECT o_orderkey, s", f"SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY {_D} DESC, o_orderpriority) AS BIGINT) AS s FROM orders"),
    "window_sum_text_order": ("FROM customer |> EXTEND SUM(c_custkey) OVER (ORDER BY c_mktsegment NULLS LAST, c_name) AS s |> SELECT c_custkey, s", "SELECT c_custkey, CAST(sum(c_custkey) OVER (ORDER BY c_mktsegment, c_name) AS BIGINT) AS s FROM customer"),
    "window_then_filter": ("FROM orders |> EXTEND COUNT(*) OVER (PARTITION BY o_custkey) AS n |> WHERE n > 15 |> SELECT o_orderkey, n", "SELECT o_orderkey, n FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 15"),
    "scalar_arith": ("FROM part |> SELECT p_partkey, (p_size + 3) * 2 - p_partkey AS i, p_size * 1.5 - p_retailprice AS d, p_size / 4 AS q", "SELECT p_partkey, (p_size + 3) * 2 - p_partkey AS i, p_size * CAST(1.5 AS DOUBLE) - p_retailprice AS d, p_size / CAST(4 AS DOUBLE) AS q FROM part"),
    "scalar_div": ("FROM part |> SELECT p_partkey, DIV(p_partkey, p_size) AS q, DIV(-p_partkey, 7) AS m", "SELECT p_partkey, p_partkey // p_size AS q, -p_partkey // 7 AS m FROM part"),
    "scalar_mod": ("FROM part |> SELECT p_partkey, MOD(p_partkey, p_size) AS q, MOD(-p_partkey, 7) AS m", "SELECT p_partkey, p_partkey % p_size AS q, -p_partkey % 7 AS m FROM part"),
    "scalar_abs_sign": ("FROM customer |> SELECT c_custkey, ABS(c_acctbal) AS a, SIGN(c_acctbal) AS s, SIGN(c_custkey - 700) AS t", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS DOUBLE) AS s, CAST(sign(c_custkey - 700) AS BIGINT) AS t FROM customer"),
    "scalar_round": ("FROM lineitem |> SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice) AS r, ROUND(l_quantity / 2) AS h", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice) AS r, round(l_quantity / 2) AS h FROM lineitem"),
    "scalar_floor_ceil": ("FROM customer |> SELECT c_custkey, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, CEILING(c_custkey) AS k", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CAST(c_custkey AS DOUBLE) AS k FROM customer"),
    "scalar_sqrt_ln_log10": ("FROM part |> SELECT p_partkey, SQRT(p_retailprice) AS s, ROUND(LN(p_retailprice) * 1000000) AS l, ROUND(LOG10(p_size) * 1000000) AS t", "SELECT p_partkey, sqrt(p_retailprice) AS s, round(ln(p_retailprice) * 1000000) AS l, round(log10(CAST(p_size AS DOUBLE)) * 1000000) AS t FROM part"),
    "scalar_exp_pow": ("FROM part |> SELECT p_partkey, ROUND(EXP(p_size / 10) * 1000) AS e, ROUND(POW(p_size, 1.5) * 1000) AS p, POWER(p_size, 2) AS q", "SELECT p_partkey, round(exp(p_size / CAST(10 AS DOUBLE)) * 1000) AS e, round(pow(p_size, CAST(1.5 AS DOUBLE)) * 1000) AS p, pow(p_size, CAST(2 AS DOUBLE)) AS q FROM part"),
    "scalar_safe_divide": ("FROM lineitem |> SELECT l_orderkey, l_linenumber, SAFE_DIVIDE(l_extendedprice, l_discount) AS r", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS r FROM lineitem"),
    "scalar_cast": ("FROM orders |> SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS d, CAST(o_orderkey + 9007199254740993 AS FLOAT64) AS f", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS d, CAST(o_orderkey + 9007199254740993 AS DOUBLE) AS f FROM orders"),
    "cond_case": ("FROM orders |> SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice <= 250000 THEN 1 ELSE 2 END AS c, CASE WHEN o_custkey > o_orderkey THEN 1.5 END AS d", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice <= 250000 THEN 1 ELSE 2 END AS BIGINT) AS c, CAST(CASE WHEN o_custkey > o_orderkey THEN 1.5 END AS DOUBLE) AS d FROM orders"),
    "cond_coalesce": ("FROM documents |> LEFT JOIN labels AS l ON documents.doc_id = l.doc_id |> SELECT documents.doc_id AS d, COALESCE(l.quality, -1) AS q, COALESCE(l.toxic, 0.5) AS t", "SELECT d.doc_id AS d, CAST(coalesce(quality, -1) AS BIGINT) AS q, coalesce(CAST(toxic AS DOUBLE), 0.5) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "cond_nullif": ("FROM nation |> SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r, NULLIF(n_regionkey, 1.0) AS d", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(nullif(n_regionkey, 2) AS BIGINT) AS r, nullif(CAST(n_regionkey AS DOUBLE), 1.0) AS d FROM nation"),
    "text_byte_length": ("FROM documents |> SELECT doc_id, BYTE_LENGTH(text) AS b", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS b FROM documents"),
    "text_char_length": ("FROM documents |> SELECT doc_id, CHAR_LENGTH(text) AS c", "SELECT doc_id, length(text) AS c FROM documents"),
    "date_year": ("FROM orders |> SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(YEAR FROM DATE_ADD(DATE '1999-12-31', INTERVAL 1 DAY)) AS k", "SELECT o_orderkey, year(o_orderdate) AS y, CAST(2000 AS BIGINT) AS k FROM orders"),
    "date_shift_const": ("FROM region |> SELECT r_regionkey, DATE_ADD(DATE '2024-01-31', INTERVAL 1 MONTH) AS m, DATE_SUB(DATE_ADD(DATE '2024-02-29', INTERVAL 1 YEAR), INTERVAL 60 DAY) AS y", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, DATE '2024-02-29' AS m, DATE '2024-12-30' AS y FROM region"),
    "report_events": (
        "FROM orders AS f |> LEFT JOIN customer AS d ON f.o_custkey = d.c_custkey |> EXTEND EXTRACT(YEAR FROM f.o_orderdate) AS y, CASE WHEN f.o_totalprice < 100000 THEN -1 ELSE 1 END AS k |> AGGREGATE COUNT(*) AS entries, SUM(f.o_orderkey) AS total GROUP BY y, d.c_mktsegment, k"
        " |> EXTEND COUNT(*) OVER (PARTITION BY c_mktsegment) AS label_groups |> EXTEND SUM(total) OVER (PARTITION BY c_mktsegment ORDER BY y) AS through_year |> ORDER BY y NULLS FIRST, c_mktsegment NULLS FIRST, k",
        f"WITH g AS (SELECT year(o_orderdate) AS y, c_mktsegment, CAST(CASE WHEN o_totalprice < 100000 THEN -1 ELSE 1 END AS BIGINT) AS k, count(*) AS entries, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS label_groups, CAST(sum(total) OVER (PARTITION BY c_mktsegment ORDER BY y) AS BIGINT) AS through_year FROM g",
    ),
    "events_by_type": ("FROM events |> EXTEND ROUND(value * 100) AS cents |> AGGREGATE COUNT(*) AS n, SUM(cents) AS s, MAX(value) AS hi GROUP AND ORDER BY event_type", "SELECT event_type, count(*) AS n, sum(round(value * 100)) AS s, max(value) AS hi FROM events GROUP BY 1"),
    "top_users": ("FROM events |> AGGREGATE COUNT(*) AS n GROUP BY user_id |> ORDER BY n DESC, user_id |> LIMIT 25", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the driver's tables."""
    found = Engine(spark, strict=False)
    for name in TABLES:
        found.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), DATES)
    return found


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = PAIRS[name][0]
        found = Engine(spark, strict=False)
        for table in TABLES:
            if table in text:  # only the tables that the text names are opened
                found.register(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"), DATES)
        return found.query(text)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(name) for name in PAIRS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS.items()}
