"""Queries for scans, expressions, joins, aggregation, sorting, windows, set operations and functions.

Each entry holds the Spark SQL text and, where the dialects differ, the DuckDB text.  Tables are Parquet
files registered as views; only what a query reads is scanned (column pruning and pushdown by Catalyst).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .catalog import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def views(spark: SparkSession, d: str, text: str) -> None:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)


def sql(spark: SparkSession, d: str, text: str, **args) -> DataFrame:
    """Run SQL over the tables of a directory; named parameters go through `args`, never through the text."""
    views(spark, d, text)
    return spark.sql(text, args=args or None)


def add(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: sql(spark, d, spark_sql)
    ORACLES[name] = duck_sql or spark_sql


# --- 2.1 scans
add("scan_seq", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
add("scan_filter_half", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 25")
add("scan_filter_percent", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 1 AND l_discount = 0")
add("scan_project_two", "SELECT l_orderkey, l_extendedprice FROM lineitem")
add("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
add("scan_range_between", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 50 AND 90")
add("scan_point", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
add("scan_versions", """SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, c_custkey % 5 + 1 AS xmin,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 3 END AS xmax FROM customer) v WHERE xmin <= 4 AND (xmax IS NULL OR xmax > 4)""")
add("values_rows", "SELECT * FROM (VALUES (1, 'Alice', 30), (2, 'Bob', 25), (3, 'Charlie', 35)) AS t(id, name, age)")
add("empty_rows", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")
add("select_without_from", "SELECT 1 AS one, 'a' AS letter")
add("column_statistics", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_totalprice) AS BIGINT) AS non_null, CAST(count(DISTINCT o_custkey) AS BIGINT) AS ndv,
    min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders""")

# --- 2.2 projection, filter, expressions
add("project_arith", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * (1 + CAST(l_tax AS DECIMAL(4, 2))), 2) AS DOUBLE) AS charge, l_quantity - 1 AS q1, -l_quantity AS neg FROM lineitem")
add("project_int_div", "SELECT o_orderkey, o_orderkey div 7 AS d, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders")
add("project_star", "SELECT n.*, n.n_nationkey * 10 AS tenfold FROM nation n")
add("filter_three_valued", """SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders) t
    WHERE NOT (p > 100000) OR (p IS NULL AND o_orderkey % 2 = 0)""")
add("filter_compare", "SELECT p_partkey FROM part WHERE p_size <> 10 AND p_size < 40 AND p_retailprice >= 950.5")
add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' OR p_name LIKE '_a%'")
add("filter_not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE '%1_'")
add("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'bUi%' OR c_name NOT ILIKE 'customer%'")
add("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')")
add("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
add("filter_null_logic", """SELECT o_orderkey, p IN (1.0, NULL) AS in_null, p BETWEEN 1 AND NULL AS between_null, p = NULL AS eq_null FROM
    (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0D END AS p FROM orders) t""", """SELECT o_orderkey, p IN (1.0, NULL) AS in_null, p BETWEEN 1 AND NULL AS between_null, p = NULL AS eq_null FROM
    (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END AS p FROM orders) t""")
add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
add("is_null", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000 WHERE c_name IS NULL AND o_custkey IS NOT NULL")
add("cast_types", """SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS as_int, CAST(o_orderkey AS STRING) AS as_text, CAST(o_orderkey AS DOUBLE) AS as_double,
    CAST(o_orderkey % 2 AS BOOLEAN) AS as_bool, CAST(o_orderdate AS DATE) AS as_date, try_cast(o_orderstatus AS INT) AS bad FROM orders WHERE o_totalprice - floor(o_totalprice) < 0.49""",
    """SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS as_int, CAST(o_orderkey AS VARCHAR) AS as_text, CAST(o_orderkey AS DOUBLE) AS as_double,
    CAST(o_orderkey % 2 AS BOOLEAN) AS as_bool, CAST(o_orderdate AS DATE) AS as_date, try_cast(o_orderstatus AS INT) AS bad FROM orders WHERE o_totalprice - floor(o_totalprice) < 0.49""")
add("concat_operator", "SELECT n_nationkey, n_name || ':' || CAST(n_regionkey AS STRING) AS tag, n_name || CAST(NULL AS STRING) AS gone FROM nation", "SELECT n_nationkey, n_name || ':' || CAST(n_regionkey AS VARCHAR) AS tag, n_name || CAST(NULL AS VARCHAR) AS gone FROM nation")
add("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
add("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
add("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
add("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
add("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("derived_table", "SELECT d.o_custkey, d.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 12")

# --- 2.3 joins
add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
add("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
add("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON c_custkey = o_custkey")
add("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 5) n")
add("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
add("join_using", "SELECT k, a.v AS av, b.v AS bv FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT c_nationkey AS k, c_name AS v FROM customer) b USING (k)")
add("join_natural", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b")
add("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
add("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
add("join_null_keys", """SELECT a.id AS aid, b.id AS bid FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS k FROM orders) a
    JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS k FROM customer) b ON a.k = b.k""")
add("join_non_equi", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000")
add("join_merge_hint", "SELECT /*+ MERGE(c) */ o_orderkey, c_mktsegment FROM orders JOIN customer c ON o_custkey = c.c_custkey", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer c ON o_custkey = c.c_custkey")
add("join_shuffle_hash_hint", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_nationkey FROM orders JOIN customer c ON o_custkey = c.c_custkey", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer c ON o_custkey = c.c_custkey")
# Spark plans the LIMIT of a LATERAL as a window without an order over rows sorted before their shuffle, which loses the order; so the window is written out
add("join_apply", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t ON o_custkey = c_custkey WHERE rn <= 2",
    "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
add("join_outer_apply", "SELECT c_custkey, t.best FROM customer LEFT JOIN LATERAL (SELECT max(o_totalprice) AS best FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') t ON true")
add("join_multi", """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")

# --- 2.4 aggregation
add("agg_hash", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders")
add("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
add("agg_expression_key", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
add("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
add("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
add("agg_group_all", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
add("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND sum(o_totalprice) > 100000")
add("agg_in_expression", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit, sum(l_quantity) > 1000 AS big FROM lineitem GROUP BY l_returnflag")
add("agg_count_null", "SELECT count(*) AS n, count(p) AS non_null FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders) t")
add("agg_first_last", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first_price, max_by(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
add("agg_array", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
add("agg_string", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
add("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_orderstatus = 'P') AS any_one FROM orders GROUP BY o_custkey")
add("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
add("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s FROM orders GROUP BY o_orderpriority")
add("agg_stats", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
add("agg_percentile", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus")
# the sketch apart from the distinct count: in one aggregation there would be a sketch for every part
add("agg_approx_distinct", """SELECT a.l_returnflag, abs(a.n - e.n) <= 0.1 * e.n AS near FROM (SELECT l_returnflag, approx_count_distinct(l_partkey, 0.02) AS n FROM lineitem GROUP BY 1) a
    JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) e ON a.l_returnflag <=> e.l_returnflag""", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
add("agg_percentile_approx", "SELECT l_returnflag, percentile_approx(l_quantity, 0.5, 10000) BETWEEN percentile(l_quantity, 0.49) AND percentile(l_quantity, 0.51) AS near FROM lineitem GROUP BY 1", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
add("agg_null_group", "SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS k FROM orders) t GROUP BY k")

# --- 2.5 windows (a superset)
add("window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)")
add("window_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(event_type, 1, 'none') OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
add("window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
add("window_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS n FROM customer")
add("join_merge_outer", "SELECT /*+ MERGE(orders) */ c_custkey, o_orderkey FROM customer FULL JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000", "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
add("join_parenthesised", "SELECT c_custkey, o_orderkey, n_name FROM customer LEFT JOIN (orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1) ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
add("window_values", "SELECT event_id, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS second, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS tile FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
add("window_percent", "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS cd FROM supplier")

# --- 2.6 sort, limit, top-k
add("sort_multi", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey) AS pos, c_custkey FROM (SELECT * FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey LIMIT 200) t")  # ranked after the limit
add("sort_nulls_last", "SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders) t ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 50")
add("sort_nulls_first", "SELECT o_orderkey, p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders) t ORDER BY p ASC NULLS FIRST, o_orderkey LIMIT 50")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
add("topk_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")

# --- 2.7 sets, CTE, recursion
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("intersect_distinct", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), avg_big AS (SELECT avg(s) AS a FROM big) SELECT o_custkey, round(s, 2) AS s FROM big, avg_big WHERE s > a")
add("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")

# --- 2.8 functions
add("fn_strings", """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, char_length(c_name) AS n, octet_length(c_name) AS b, substring(c_name, 3, 4) AS s, trim('  x ') AS t,
    ltrim('  x') AS lt, rtrim('x  ') AS rt, reverse(c_name) AS rv, left(c_name, 3) AS le, right(c_name, 3) AS ri, replace(c_name, 'Customer', 'C') AS rp, position('#' IN c_name) AS p FROM customer""",
    """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::INT AS n, octet_length(c_name::BLOB)::INT AS b, substring(c_name, 3, 4) AS s, trim('  x ') AS t,
    ltrim('  x') AS lt, rtrim('x  ') AS rt, reverse(c_name) AS rv, left(c_name, 3) AS le, right(c_name, 3) AS ri, replace(c_name, 'Customer', 'C') AS rp, position('#' IN c_name)::INT AS p FROM customer""")
add("fn_concat", "SELECT c_custkey, concat_ws('', c_name, NULL, c_mktsegment) AS c FROM customer", "SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS c FROM customer")
add("fn_math", """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, round(power(c_custkey, 2), 0) AS pw,
    mod(c_custkey, 7) AS m, CAST(sign(c_acctbal) AS INT) AS sg, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal) ELSE ceil(c_acctbal) END AS tr FROM customer""",
    """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, round(power(c_custkey, 2), 0) AS pw,
    mod(c_custkey, 7) AS m, CAST(sign(c_acctbal) AS INT) AS sg, CAST(trunc(c_acctbal) AS BIGINT) AS tr FROM customer""")
add("fn_transcendental", """SELECT p_partkey, round(exp(p_size / 50.0D), 6) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t,
    round(asin(p_size / 100.0D), 6) AS a1, round(acos(p_size / 100.0D), 6) AS a2, round(atan(p_size), 6) AS a3, round(sinh(p_size / 10.0D), 4) AS sh, round(cosh(p_size / 10.0D), 4) AS ch, round(tanh(p_size), 6) AS th FROM part""",
    """SELECT p_partkey, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t,
    round(asin(p_size / 100.0), 6) AS a1, round(acos(p_size / 100.0), 6) AS a2, round(atan(p_size), 6) AS a3, round(sinh(p_size / 10.0), 4) AS sh, round(cosh(p_size / 10.0), 4) AS ch, round(tanh(p_size), 6) AS th FROM part""")
add("fn_round", "SELECT o_orderkey, round(o_totalprice) AS r0, round(o_totalprice, 1) AS r1, round(o_totalprice, -2) AS rm FROM orders WHERE abs(o_totalprice * 10 - floor(o_totalprice * 10) - 0.5) > 0.01")
add("fn_null", "SELECT o_orderkey, coalesce(p, 0) AS c, nullif(o_orderstatus, 'F') AS nf, ifnull(p, -1) AS i FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders) t")
add("fn_dates", """SELECT o_orderkey, date_trunc('MONTH', o_orderdate) AS tr, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q, CAST(o_orderdate AS DATE) AS d,
    date_format(o_orderdate, 'yyyy-MM-dd') AS txt, to_date('2024-02-03', 'yyyy-MM-dd') AS td, CAST(datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') AS BIGINT) AS age_days FROM orders""",
    """SELECT o_orderkey, date_trunc('month', o_orderdate) AS tr, extract(YEAR FROM o_orderdate) AS y, date_part('quarter', o_orderdate) AS q, CAST(o_orderdate AS DATE) AS d,
    strftime(o_orderdate, '%Y-%m-%d') AS txt, DATE '2024-02-03' AS td, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS age_days FROM orders""")
add("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, json_array_length('[1,2,3]') AS n, schema_of_variant(parse_json(props)) IS NOT NULL AS typed FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_array_length('[1,2,3]') AS INT) AS n, json_type(props) IS NOT NULL AS typed FROM events")
add("fn_arrays", "SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first_one, array_contains(array(1, 2, 3), label) AS has FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first_one, list_contains([1, 2, 3], label) AS has FROM embeddings")
add("fn_unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(array(n_regionkey, n_regionkey + 10)) e AS x", "SELECT n_nationkey, unnest([n_regionkey, n_regionkey + 10]) AS x FROM nation")
add("fn_uuid", "SELECT n_nationkey, length(uuid()) AS n FROM nation", "SELECT n_nationkey, CAST(length(CAST(uuid() AS VARCHAR)) AS INT) AS n FROM nation")
add("fn_clock", "SELECT current_timestamp() IS NOT NULL AS now_set, current_date() >= DATE'2020-01-01' AS today_set, rand() < 1 AS random_ok", "SELECT now() IS NOT NULL AS now_set, current_date >= DATE '2020-01-01' AS today_set, random() < 1 AS random_ok")
