"""The registered queries of the SQL engine, each with the SQL that DuckDB checks it by.

An entry is (engine SQL, DuckDB SQL); None for the second means that both read the same text. DuckDB's
text differs where its own rules do: sums of ints are wider there, `/` and `%` follow operand types, and
NULL in BETWEEN, GREATEST and SUBSTRING is spelt out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tabulon.plans import files
from tabulon.session import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, tuple[str, str | None]] = {
    # scan and project
    "scan_star": ("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "project_expr": ("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_linenumber + 1 AS next_line FROM lineitem", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, CAST(l_linenumber + 1 AS BIGINT) AS next_line FROM lineitem"),
    "qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT CAST(n.n_nationkey AS BIGINT) AS n_nationkey, n.n_name, CAST(n.n_regionkey AS BIGINT) AS n_regionkey, r.r_name AS \"r.r_name\" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "select_no_from": ("SELECT 1 AS one, 'a' AS letter, 2.5 AS num, TRUE AS yes", "SELECT CAST(1 AS BIGINT) AS one, 'a' AS letter, 2.5::DOUBLE AS num, TRUE AS yes"),
    "alias_titles": ("SELECT c_name AS name, c_acctbal balance FROM customer", None),
    # filters
    "filter_compare": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'", None),
    "filter_and_or_not": ("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND c_nationkey > 5", None),
    "filter_in": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", None),
    "filter_not_in_null": ("SELECT COUNT(*) AS n FROM customer WHERE c_nationkey NOT IN (1, NULL)", None),
    "filter_between": ("SELECT l_orderkey, l_linenumber AS line, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12"),
    "filter_between_null": ("SELECT c_custkey, c_acctbal BETWEEN NULL AND 1000 AS low_open, NULL BETWEEN c_acctbal AND 5 AS null_value FROM customer", "SELECT c_custkey, c_acctbal <= 1000 AS low_open, FALSE AS null_value FROM customer"),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e_'", None),
    "filter_like_affix": ("SELECT p_partkey FROM part WHERE p_type LIKE 'S%' OR p_name LIKE '%1' OR p_brand LIKE '%nd#1%'", None),
    "filter_like_escape": ("SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand!#1%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#1%'"),
    "filter_ilike": ("SELECT p_partkey FROM part WHERE p_type ILIKE '%STEEL%' OR p_brand ILIKE 'brand#2_'", None),
    "filter_is_null": ("SELECT c.c_custkey AS k, o.o_orderkey IS NULL AS none FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL OR c.c_nationkey IS NOT NULL", None),
    "filter_is_true_false": ("SELECT o_orderkey, (o_totalprice > 150000) IS TRUE AS big, (o_totalprice > 150000) IS NOT FALSE AS maybe FROM orders WHERE (o_orderstatus = 'O') IS FALSE", None),
    "filter_truthy_number": ("SELECT n_nationkey AS k FROM nation WHERE n_regionkey", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey <> 0"),
    "filter_date_text": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= '1997/1/5' AND o_orderdate < '1998-02-01'", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-05' AND o_orderdate < TIMESTAMP '1998-02-01'"),
    # expressions
    "arith": ("SELECT l_orderkey, l_quantity + l_tax * 2 - 1 AS x, l_linenumber * 3 AS y FROM lineitem", "SELECT l_orderkey, l_quantity + l_tax * 2 - 1 AS x, CAST(l_linenumber * 3 AS BIGINT) AS y FROM lineitem"),
    "divide_float": ("SELECT o_orderkey, o_custkey / 7 AS q FROM orders", "SELECT o_orderkey, o_custkey::DOUBLE / 7::DOUBLE AS q FROM orders"),
    "modulo_int": ("SELECT o_orderkey, o_custkey % 7 AS r, o_totalprice % 10 AS f FROM orders", "SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS r, CAST(CAST(trunc(o_totalprice) AS BIGINT) % 10 AS BIGINT) AS f FROM orders"),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS neg, -(-2.5) AS lit FROM customer", "SELECT c_custkey, -c_acctbal AS neg, 2.5::DOUBLE AS lit FROM customer"),
    "concat_op": ("SELECT c_name || '/' || c_nationkey AS tag, c_name || NULL AS nothing FROM customer", "SELECT c_name || '/' || c_nationkey AS tag, CAST(NULL AS VARCHAR) AS nothing FROM customer"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS BIGINT) AS code FROM orders"),
    "cast_int": ("SELECT l_orderkey, CAST(l_extendedprice AS INT) AS whole, CAST('42' AS BIGINT) AS lit FROM lineitem", "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(42 AS BIGINT) AS lit FROM lineitem"),
    "cast_float": ("SELECT n_nationkey::DOUBLE AS d, CAST('2.5' AS FLOAT) AS lit FROM nation", "SELECT CAST(n_nationkey AS DOUBLE) AS d, 2.5::DOUBLE AS lit FROM nation"),
    "cast_bool": ("SELECT CAST('TRUE' AS BOOLEAN) AS t, CAST('0' AS BOOL) AS f FROM region", "SELECT TRUE AS t, FALSE AS f FROM region"),
    "cast_text": ("SELECT CAST(p_size AS CHAR) AS s, CAST(p_size * 1.0 AS TEXT) AS whole, CAST(p_partkey % 4 / 4 AS TEXT) AS part FROM part", "SELECT CAST(p_size AS VARCHAR) AS s, CAST(p_size AS VARCHAR) AS whole, CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END AS part FROM part"),
    # joins
    "join_inner": ("SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", None),
    "join_right": ("SELECT o.o_orderkey AS o, c.c_custkey AS k FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", None),
    "join_full": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL OUTER JOIN region b ON a.n_nationkey = b.r_regionkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.r_regionkey AS BIGINT) AS b FROM nation a FULL OUTER JOIN region b ON a.n_nationkey = b.r_regionkey"),
    "join_cross": ("SELECT a.r_name AS x, b.n_name AS y FROM region a CROSS JOIN nation b", None),
    "join_comma_where": ("SELECT n.n_name AS n, r.r_name AS r FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_using": ("SELECT a.o_orderkey AS k, a.o_totalprice AS p, b.o_orderstatus AS s FROM orders a JOIN orders b USING (o_orderkey, o_custkey)", "SELECT a.o_orderkey AS k, a.o_totalprice AS p, b.o_orderstatus AS s FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey"),
    "join_multi_key": ("SELECT a.l_orderkey AS k, a.l_linenumber AS line, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber", "SELECT a.l_orderkey AS k, CAST(a.l_linenumber AS BIGINT) AS line, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber"),
    "join_theta": ("SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", None),
    "join_equi_residual": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 20", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_chain_5": ("SELECT r.r_name AS region, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name", None),
    # aggregates
    "agg_global": ("SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, SUM(o_custkey) AS keys FROM orders", "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", None),
    "agg_group": ("SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority", None),
    "agg_group_expr": ("SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", "SELECT CAST(o_custkey % 10 AS BIGINT) AS bucket, COUNT(*) AS n FROM orders GROUP BY 1"),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000", None),
    "agg_bare_column": ("SELECT n_regionkey AS k, COUNT(*) AS n, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS k, COUNT(*) AS n, MIN(r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "sum_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS s, SUM(DISTINCT l_quantity) AS q FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, SUM(DISTINCT l_quantity) AS q FROM lineitem"),
    "avg_distinct": ("SELECT l_returnflag, ROUND(AVG(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag", None),
    "min_max_text": ("SELECT MIN(c_name) AS lo, MAX(c_mktsegment) AS hi, MIN(o_orderdate) AS first_day FROM customer JOIN orders ON o_custkey = c_custkey", None),
    "agg_in_expr": ("SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*) + MAX(l_tax), 6) AS x, CASE WHEN COUNT(*) > 10000 THEN 'many' ELSE 'few' END AS size FROM lineitem GROUP BY l_returnflag", None),
    "order_by_agg": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY SUM(c_acctbal) DESC LIMIT 2", None),
    "group_null_key": ("SELECT CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k, COUNT(*) AS n FROM nation GROUP BY CASE WHEN n_regionkey > 1 THEN n_regionkey END", "SELECT CAST(CASE WHEN n_regionkey > 1 THEN n_regionkey END AS BIGINT) AS k, COUNT(*) AS n FROM nation GROUP BY 1"),
    "group_int_float": ("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE n_regionkey * 1.0 END AS k, COUNT(*) AS n FROM nation GROUP BY CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE n_regionkey * 1.0 END", "SELECT CAST(n_regionkey AS DOUBLE) AS k, COUNT(*) AS n FROM nation GROUP BY 1"),
    # distinct, sort, limit
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_order": ("SELECT DISTINCT n_regionkey AS k FROM nation ORDER BY k DESC LIMIT 3", "SELECT CAST(k AS BIGINT) AS k FROM (SELECT DISTINCT n_regionkey AS k FROM nation ORDER BY k DESC LIMIT 3) q"),
    "order_multi": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey LIMIT 50", None),
    "order_alias": ("SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, k LIMIT 20", None),
    "order_hidden_col": ("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20", None),
    "order_expr": ("SELECT c_custkey FROM customer ORDER BY ABS(c_acctbal - 5000), c_custkey LIMIT 20", None),
    "order_nulls": ("SELECT CASE WHEN n_nationkey > 20 THEN n_nationkey END AS k, n_name FROM nation ORDER BY k, n_name LIMIT 10", "SELECT CAST(k AS BIGINT) AS k, n_name FROM (SELECT CASE WHEN n_nationkey > 20 THEN n_nationkey END AS k, n_name FROM nation) q ORDER BY k NULLS FIRST, n_name LIMIT 10"),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 10", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3, 4", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 3"),
    # strings
    "fn_len": ("SELECT c_custkey, LEN(c_name) AS a, CHAR_LENGTH('héé') AS b FROM customer", "SELECT c_custkey, CAST(LENGTH(c_name) AS BIGINT) AS a, CAST(3 AS BIGINT) AS b FROM customer"),
    "fn_case": ("SELECT LOWER(n_name) AS lo, UCASE(n_name) AS up FROM nation", "SELECT LOWER(n_name) AS lo, UPPER(n_name) AS up FROM nation"),
    "fn_trim": ("SELECT TRIM('  ' || n_name || ' ') AS t, LTRIM('  x ') AS l, RTRIM(' x  ') AS r FROM nation", "SELECT n_name AS t, 'x ' AS l, ' x' AS r FROM nation"),
    "fn_trim_chars": ("SELECT TRIM(BOTH 'AN' FROM n_name) AS b, TRIM(LEADING 'N' FROM n_name) AS l, TRIM(TRAILING '0123456789' FROM n_name) AS t FROM nation", "SELECT TRIM(n_name, 'AN') AS b, LTRIM(n_name, 'N') AS l, RTRIM(n_name, '0123456789') AS t FROM nation"),
    "fn_concat": ("SELECT CONCAT(n_name, '-', n_regionkey) AS a, CONCAT(n_name, NULL) AS b FROM nation", "SELECT n_name || '-' || n_regionkey AS a, CAST(NULL AS VARCHAR) AS b FROM nation"),
    "fn_substring": ("SELECT SUBSTRING(c_name, 3, 4) AS a, SUBSTR(c_name, 0, 4) AS b, SUBSTRING(c_name, -2, 3) AS c, SUBSTRING(c_name, 5) AS d FROM customer", "SELECT SUBSTRING(c_name, 3, 4) AS a, '' AS b, SUBSTRING(c_name, 1, 3) AS c, SUBSTRING(c_name, 5) AS d FROM customer"),
    "fn_substring_from_for": ("SELECT SUBSTRING(c_name FROM 2 FOR 5) AS a FROM customer", "SELECT SUBSTRING(c_name, 2, 5) AS a FROM customer"),
    "fn_replace": ("SELECT REPLACE(c_name, 'Customer', 'C') AS a FROM customer", None),
    "fn_left_right": ("SELECT LEFT(c_name, 4) AS a, RIGHT(c_name, 3) AS b, LEFT(c_name, -1) AS c FROM customer", "SELECT LEFT(c_name, 4) AS a, RIGHT(c_name, 3) AS b, '' AS c FROM customer"),
    "fn_instr": ("SELECT c_custkey, INSTR(c_name, '0') AS a, INSTR(c_name, 'zz') AS b FROM customer", None),
    "fn_starts_ends": ("SELECT c_custkey, STARTSWITH(c_name, 'Cust') AS a, ENDSWITH(c_name, '7') AS b FROM customer", "SELECT c_custkey, starts_with(c_name, 'Cust') AS a, ends_with(c_name, '7') AS b FROM customer"),
    "fn_split": ("SELECT SPLIT(p_type, ' ', 1) AS a, SPLIT(p_type, ' ', 9) AS b, SPLIT('a.b', '.', 2) AS c FROM part", "SELECT split_part(p_type, ' ', 1) AS a, CAST(NULL AS VARCHAR) AS b, 'b' AS c FROM part"),
    # numbers
    "fn_abs": ("SELECT c_custkey, ABS(c_acctbal) AS a, ABS(c_custkey - 500) AS b FROM customer", None),
    "fn_round": ("SELECT o_orderkey, ROUND(o_totalprice) AS a, ROUND(o_totalprice / 7, 1) AS b FROM orders", None),
    "fn_floor_ceil": ("SELECT c_custkey, FLOOR(c_acctbal) AS a, CEIL(c_acctbal) AS b, CEILING(c_nationkey) AS c FROM customer", "SELECT c_custkey, CAST(FLOOR(c_acctbal) AS DOUBLE) AS a, CAST(CEIL(c_acctbal) AS DOUBLE) AS b, CAST(c_nationkey AS DOUBLE) AS c FROM customer"),
    "fn_mod": ("SELECT c_custkey, MOD(c_custkey, 9) AS a, MOD(-7, 3) AS b FROM customer", "SELECT c_custkey, CAST(c_custkey % 9 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM customer"),
    "fn_power_sqrt": ("SELECT n_nationkey AS k, POWER(n_nationkey, 2) AS a, POW(2, 0.5) AS b, SQRT(n_nationkey) AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, POWER(n_nationkey, 2)::DOUBLE AS a, POW(2, 0.5)::DOUBLE AS b, SQRT(n_nationkey) AS c FROM nation"),
    "fn_greatest_least": ("SELECT n_nationkey AS k, GREATEST(n_nationkey, n_regionkey, 3) AS a, LEAST(n_nationkey, 2.5) AS b, GREATEST(n_nationkey, NULL) AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(GREATEST(n_nationkey, n_regionkey, 3) AS BIGINT) AS a, LEAST(n_nationkey::DOUBLE, 2.5::DOUBLE) AS b, CAST(NULL AS BIGINT) AS c FROM nation"),
    # dates and NULL
    "fn_date": ("SELECT o_orderkey, DATE(o_orderdate) AS d, DATE('2026/5/7') AS t, DATE('nope') AS x FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, '2026-05-07' AS t, 'nope' AS x FROM orders"),
    "fn_now_shape": ("SELECT NOW() >= '2020-01-01' AS after, DATE() IS NOT NULL AS today FROM region", "SELECT TRUE AS after, TRUE AS today FROM region"),
    "fn_ifnull": ("SELECT c.c_custkey AS k, IFNULL(o.o_orderkey, -1) AS o, ISNULL(NULL, c.c_name) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", "SELECT c.c_custkey AS k, COALESCE(o.o_orderkey, -1) AS o, c.c_name AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"),
    "fn_coalesce": ("SELECT n_nationkey AS k, COALESCE(NULL, CASE WHEN n_regionkey > 2 THEN n_name END, 'none') AS a FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, COALESCE(CASE WHEN n_regionkey > 2 THEN n_name END, 'none') AS a FROM nation"),
    # whole reports
    "q1": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS cnt FROM lineitem WHERE l_shipdate <= '1999-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "q3": ("SELECT l.l_orderkey AS k, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate AS day FROM customer c, orders o, lineitem l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < '1998-03-15' AND l.l_shipdate > '1998-03-15' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, k LIMIT 10", None),
    "q5": ("SELECT n.n_name AS nation, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c, orders o, lineitem l, supplier s, nation n, region r WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' GROUP BY n.n_name ORDER BY revenue DESC", None),
    "q6": ("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
    "q10": ("SELECT c.c_custkey AS k, c.c_name AS name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, c.c_acctbal AS balance, n.n_name AS nation FROM customer c, orders o, lineitem l, nation n WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND c.c_nationkey = n.n_nationkey GROUP BY c.c_custkey, c.c_name, c.c_acctbal, n.n_name ORDER BY revenue DESC, k LIMIT 20", None),
    "q12": ("SELECT o.o_orderpriority AS priority, SUM(CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END) AS large, SUM(CASE WHEN l.l_quantity > 25 THEN 0 ELSE 1 END) AS small FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate >= '1997-01-01' GROUP BY o.o_orderpriority", "SELECT o.o_orderpriority AS priority, CAST(SUM(CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, CAST(SUM(CASE WHEN l.l_quantity > 25 THEN 0 ELSE 1 END) AS BIGINT) AS small FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate >= '1997-01-01' GROUP BY o.o_orderpriority"),
    "q14": ("SELECT ROUND(100 * SUM(CASE WHEN p.p_type LIKE '%S%' THEN l.l_extendedprice * (1 - l.l_discount) ELSE 0.0 END) / SUM(l.l_extendedprice * (1 - l.l_discount)), 4) AS share FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey", None),
    # metadata
    "show_tables": ("SHOW TABLES", "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ') v("Tables")'),
    "show_tables_like": ("SHOW TABLES LIKE 'n%'", "SELECT 'nation' AS \"Tables\""),
    "show_databases": ("SHOW DATABASES", "SELECT 'main' AS \"Database\""),
    "describe": ("DESCRIBE orders", "SELECT * FROM (VALUES ('o_orderkey', 'Integer'), ('o_custkey', 'Integer'), ('o_orderstatus', 'Text'), ('o_totalprice', 'Float'), ('o_orderdate', 'Text'), ('o_orderpriority', 'Text')) v(\"Column\", \"Type\")"),
    "show_columns": ("SHOW COLUMNS FROM region", "SELECT * FROM (VALUES ('r_regionkey', 'Integer'), ('r_name', 'Text')) v(\"Column\", \"Type\")"),
    "use": ("USE main", "SELECT 'Database changed' AS \"Status\""),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).load_dir(sf_dir, TABLES).sql(QUERIES[name][0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in QUERIES} | files.queries()


def oracle_sql() -> dict[str, str]:
    return {name: oracle or sql for name, (sql, oracle) in QUERIES.items()} | files.oracle_sql()
