"""Registered queries that go through files: sinks and sources of the engine, with the SQL that DuckDB checks them by.

Files lie in the folder of spark.checkpoint.dir, which all executors share, or on one machine in a new temporary one.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tabulon.errors import QueryError
from tabulon.render import render
from tabulon.session import Engine

#: A file's text, how it is read, a statement over its table `data`, and DuckDB's SQL.
TEXTS: dict[str, tuple[str, dict, str, str]] = {
    "csv_types": (
        'i,f,b,t,m\n1,1.5,true,007,1\n-2,3,FALSE,"a,b",x\n,,,,\n3,,,"c\nd",2.50\n4\n',
        {},
        "SELECT * FROM data",
        "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 1.5::DOUBLE, TRUE, '007', '1'), (-2, 3.0, FALSE, 'a,b', 'x'), (3, NULL, NULL, 'c' || chr(10) || 'd', '2.5'), (4, NULL, NULL, NULL, NULL)) v(i, f, b, t, m)",
    ),
    "csv_options": ("1;NA\n2;ok\n3;\n", {"delimiter": ";", "header": False, "null_value": "NA"}, "SELECT col1, col2 FROM data WHERE col2 IS NULL OR col1 > 1", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), NULL), (2, 'ok'), (3, NULL)) v(col1, col2)"),
    "csv_headers": ("Name,,Name,Na-me\na,1,b,c\n", {}, "SELECT name, col2, name_1, na_me FROM data", "SELECT 'a' AS name, CAST(1 AS BIGINT) AS col2, 'b' AS name_1, 'c' AS na_me"),
    "csv_header_only": ("a,b\n", {}, "SELECT COUNT(*) AS n FROM data", "SELECT COUNT(*) AS n FROM region WHERE r_regionkey < 0"),
}
#: A statement whose result is written with INTO OUTFILE, one over the file read again as `data`, and DuckDB's SQL.
TRIPS: dict[str, tuple[str, str, str]] = {
    "outfile_csv": ("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "SELECT * FROM data", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"),
    "outfile_nulls": (
        "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN 'say \"F\", then' END AS said FROM orders",
        "SELECT said, COUNT(*) AS n, COUNT(price) AS prices FROM data GROUP BY said",
        "SELECT CASE WHEN o_orderstatus = 'F' THEN 'say \"F\", then' END AS said, COUNT(*) AS n, COUNT(CASE WHEN o_totalprice > 200000 THEN 1 END) AS prices FROM orders GROUP BY 1",
    ),
}
#: A statement, the form it is shown in, and DuckDB's SQL for the text.
SHOWN: dict[str, tuple[str, str, str]] = {
    "render_csv": ("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 ORDER BY k", "csv", "SELECT 'k,name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS shown FROM nation WHERE n_regionkey = 1"),
    "render_json": ("SELECT r_regionkey AS k, r_name AS name FROM region ORDER BY k", "json", "SELECT CAST(to_json(list({'k': r_regionkey, 'name': r_name} ORDER BY r_regionkey)) AS VARCHAR) AS shown FROM region"),
    "render_yaml": ("SELECT n_nationkey AS k FROM nation ORDER BY k", "yaml", "SELECT string_agg('- k: ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS shown FROM nation"),
}
#: Statements that are refused; the result says so.
REFUSED = {
    "refuse_set_operation": "SELECT 1 UNION SELECT 2",
    "refuse_subquery": "SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)",
    "refuse_cte": "WITH x AS (SELECT 1) SELECT * FROM x",
    "refuse_window": "SELECT ROW_NUMBER() OVER (ORDER BY n_name) FROM nation",
    "refuse_rollup": "SELECT n_regionkey, COUNT(*) FROM nation GROUP BY ROLLUP(n_regionkey)",
    "refuse_distinct_on": "SELECT DISTINCT ON (n_regionkey) n_name FROM nation",
    "refuse_filter": "SELECT COUNT(*) FILTER (WHERE n_regionkey > 1) FROM nation",
    "refuse_natural_join": "SELECT * FROM nation NATURAL JOIN region",
    "refuse_dml": "DELETE FROM nation",
    "refuse_two_statements": "SELECT 1; SELECT 2",
    "refuse_aggregate_in_where": "SELECT n_name FROM nation WHERE COUNT(*) > 1",
}


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = os.path.join(re.sub(r"^file:/+", "/", shared), f"files-{uuid.uuid4().hex}") if shared else tempfile.mkdtemp(prefix="tabulon-")
    os.makedirs(found, exist_ok=True)
    return found


def from_text(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text, options, sql, _ = TEXTS[name]
    path = os.path.join(folder(spark), "data.csv")
    with open(path, "w", newline="") as out:
        out.write(text)
    return Engine(spark).load(path, **options).sql(sql)


def round_trip(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.plans.catalogue import TABLES

    written, sql, _ = TRIPS[name]
    path = os.path.join(folder(spark), "data.csv")
    Engine(spark).load_dir(sf_dir, TABLES).sql(f"{written} INTO OUTFILE '{path}'")
    return Engine(spark).load(path, null_value="NULL").sql(sql)


def shown(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.plans.catalogue import TABLES

    sql, form, _ = SHOWN[name]
    result = Engine(spark).load_dir(sf_dir, TABLES).run(sql, stats=False)
    text = render(form, result.columns, result.rows)
    return spark.createDataFrame([(json.dumps(json.loads(text), separators=(",", ":")) if form == "json" else text,)], "shown string")


def refused(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.plans.catalogue import TABLES

    try:
        Engine(spark).load_dir(sf_dir, TABLES).sql(REFUSED[name])
        told = False
    except QueryError:
        told = True
    return spark.createDataFrame([(told,)], "refused boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [(TEXTS, from_text), (TRIPS, round_trip), (SHOWN, shown), (REFUSED, refused)]
    return {name: partial(how, name) for names, how in made for name in names}


def oracle_sql() -> dict[str, str]:
    return {name: entry[-1] for table in (TEXTS, TRIPS, SHOWN) for name, entry in table.items()} | dict.fromkeys(REFUSED, "SELECT TRUE AS refused")
