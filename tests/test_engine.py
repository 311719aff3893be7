"""Statements over small tables: rows out, or the error."""

from __future__ import annotations

import datetime

import pytest

from tabulon.errors import QueryError, UnsupportedError
from tabulon.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("people", spark.createDataFrame([(1, "Alice", 30, "NY"), (2, "Bob", 25, "LA"), (3, "Carol", 35, "SF"), (4, "Dan", 40, "NY"), (5, "Eve", 28, "LA")], "id long, name string, age long, city string"))
    e.register("orders", spark.createDataFrame([(101, 1, 50.5), (102, 2, 20.0), (103, 1, 99.9)], "order_id long, customer_id long, amount double"))
    e.register("gaps", spark.createDataFrame([(1, None), (None, "x"), (None, None), (2, "y")], "k long, v string"))
    e.register("days", spark.createDataFrame([(1, datetime.date(2026, 5, 7)), (2, datetime.date(2026, 5, 8))], "id long, day date"))
    return e


def rows(engine, sql):
    return engine.run(sql, stats=False).rows


CASES = [
    ("SELECT name FROM people WHERE age > 28 AND city = 'NY' ORDER BY name", [("Alice",), ("Dan",)]),
    ('SELECT name FROM people WHERE city = "LA" ORDER BY id DESC', [("Eve",), ("Bob",)]),
    ("SELECT city, COUNT(*) AS n FROM people GROUP BY city ORDER BY COUNT(*) DESC, city", [("LA", 2), ("NY", 2), ("SF", 1)]),
    ("SELECT city, COUNT(*) FROM people GROUP BY city HAVING COUNT(*) > 1 AND MAX(age) < 30", [("LA", 2)]),
    ("SELECT COUNT(*), SUM(age), MIN(name), AVG(age) FROM people WHERE id > 100", [(0, None, None, None)]),
    ("SELECT 1 FROM people GROUP BY 1", [(1,)]),
    ("SELECT 1 FROM people WHERE id > 100 GROUP BY 1", []),
    ("SELECT name, COUNT(*) FROM people GROUP BY city ORDER BY name", [("Alice", 2), ("Bob", 2), ("Carol", 1)]),
    ("SELECT p.name, o.amount FROM people p JOIN orders o ON p.id = o.customer_id ORDER BY amount", [("Bob", 20.0), ("Alice", 50.5), ("Alice", 99.9)]),
    ("SELECT people.name FROM people p LEFT JOIN orders ON p.id = customer_id WHERE order_id IS NULL ORDER BY p.id", [("Carol",), ("Dan",), ("Eve",)]),
    ("SELECT o.order_id, p.name FROM people p RIGHT JOIN orders o ON p.id = o.customer_id AND p.age > 26 ORDER BY 1, order_id", [(101, "Alice"), (102, None), (103, "Alice")]),
    ("SELECT COUNT(*) FROM people a FULL JOIN orders b ON a.id = b.order_id", [(8,)]),
    ("SELECT COUNT(*) FROM people, orders", [(15,)]),
    ("SELECT a.name, b.name FROM people a JOIN people b ON a.city = b.city AND a.id < b.id ORDER BY a.id", [("Alice", "Dan"), ("Bob", "Eve")]),
    ("SELECT COUNT(*) FROM people a JOIN people b USING (id, city)", [(5,)]),
    ("SELECT DISTINCT city FROM people ORDER BY age", [("LA",), ("NY",), ("SF",)]),
    ("SELECT name FROM people ORDER BY 1, id DESC LIMIT 1, 2", [("Dan",), ("Carol",)]),
    ("SELECT name FROM people ORDER BY id LIMIT 2 OFFSET 3", [("Dan",), ("Eve",)]),
    ("SELECT name FROM people ORDER BY id LIMIT -1", []),
    ("SELECT k FROM gaps ORDER BY k", [(None,), (None,), (1,), (2,)]),
    ("SELECT k FROM gaps ORDER BY k DESC NULLS FIRST", [(None,), (None,), (2,), (1,)]),
    ("SELECT k, COUNT(v), COUNT(*) FROM gaps GROUP BY k ORDER BY k", [(None, 1, 2), (1, 0, 1), (2, 1, 1)]),
    ("SELECT id FROM days WHERE day = '2026/5/7'", [(1,)]),
    ("SELECT id FROM days WHERE day > '2026-05-07'", [(2,)]),
    ("SELECT id FROM days WHERE day = 'soon'", []),
    ("SELECT SUM(DISTINCT age - age % 10), AVG(DISTINCT age % 2) FROM people", [(90, 0.5)]),
    ("SELECT COUNT(DISTINCT city) * 2 + 1 FROM people", [(7,)]),
    ("SELECT age * 2 AS twice FROM people WHERE id = 1 OR id = 2 ORDER BY twice", [(50,), (60,)]),
]


@pytest.mark.parametrize(("sql", "wanted"), CASES)
def test_statement(engine, sql, wanted):
    assert rows(engine, sql) == wanted


SCALARS = [
    ("1 + 2 * 3", 7),
    ("7 / 2", 3.5),
    ("7.9 % 3", 1),
    ("-7 % 3", -1),
    ("-2.5", -2.5),
    ("'a' || 1.0 || TRUE", "a1true"),
    ("NULL || 'a'", None),
    ("1 IN (2, NULL)", None),
    ("1 NOT IN (2, 3)", True),
    ("NULL IN (1)", None),
    ("1 IN ('1', 1)", True),
    ("NULL BETWEEN 1 AND 2", False),
    ("5 BETWEEN NULL AND 9", True),
    ("5 NOT BETWEEN 1 AND NULL", True),
    ("'b' BETWEEN 'a' AND 'c'", True),
    ("NULL AND FALSE", False),
    ("NULL OR 1", True),
    ("NOT NULL", None),
    ("NULL IS FALSE", False),
    ("0 IS FALSE", True),
    ("'' IS TRUE", False),
    ("1 = 1.0", True),
    ("'1' = 1", False),
    ("'1' > 5", True),
    ("TRUE < 0", True),
    ("'Alice' LIKE 'A%e'", True),
    ("'Alice' LIKE 'li'", False),
    ("'a%b' LIKE 'a!%b' ESCAPE '!'", True),
    ("'a.b' LIKE 'a_b'", True),
    ("'axb' LIKE 'a.b'", False),
    ("'a\nb' LIKE 'a_b'", True),
    ("'ALICE' ILIKE 'al%'", True),
    ("NULL LIKE 'a'", None),
    ("12.5 LIKE '12._'", True),
    ("CASE WHEN NULL THEN 1 WHEN 2 > 1 THEN 2.5 END", 2.5),
    ("CASE 3 WHEN 1 THEN 'a' END", None),
    ("CASE 1 WHEN 1 THEN 1 ELSE 'x' END", "1"),
    ("CAST('42' AS INT)", 42),
    ("CAST(2.9 AS INT)", 2),
    ("CAST(NULL AS INT)", None),
    ("'1.5'::DOUBLE", 1.5),
    ("CAST('1' AS BOOLEAN)", True),
    ("CAST(20.0 AS CHAR)", "20"),
    ("CAST(0.1 + 0.2 AS TEXT)", "0.30000000000000004"),
    ("CAST(12345678.5 AS TEXT)", "12345678.5"),
    ("LEN('héé')", 3),
    ("UPPER('ab') || LCASE('CD')", "ABcd"),
    ("TRIM('\t a \n')", "a"),
    ("LTRIM('  a ') || '|' || RTRIM(' a  ')", "a | a"),
    ("TRIM(LEADING 'xy' FROM 'xyaxy')", "axy"),
    ("TRIM(BOTH 'yx' FROM 'xyaxy')", "a"),
    ("CONCAT('a', 1, NULL)", None),
    ("SUBSTRING('hello', 2, 3)", "ell"),
    ("SUBSTRING('hello', 0, 3)", ""),
    ("SUBSTRING('hello', -2, 3)", "hel"),
    ("SUBSTRING('hello', 2, -1)", ""),
    ("SUBSTRING('hello' FROM 4)", "lo"),
    ("REPLACE('aXbX', 'X', '-')", "a-b-"),
    ("LEFT('hello', 2) || RIGHT('hello', 2) || LEFT('a', -1)", "helo"),
    ("INSTR('hello', 'l')", 3),
    ("INSTR('hello', 'z')", 0),
    ("STARTSWITH('abc', 'ab') AND ENDSWITH('abc', 'bc')", True),
    ("SPLIT('a.b.c', '.', 2)", "b"),
    ("SPLIT('a.b', '.', 9)", None),
    ("SPLIT('a.b', '.', 0)", None),
    ("SPLIT('a.b.', '.', 3)", ""),
    ("SPLIT('ab', '', 1)", "ab"),
    ("ABS(-3)", 3),
    ("ABS(-2.5)", 2.5),
    ("ROUND(2.5)", 3.0),
    ("ROUND(-2.345, 2)", -2.35),
    ("ROUND(1.005, 2)", 1.0),
    ("FLOOR(-1.5)", -2.0),
    ("CEIL(1.2) + CEILING(1.0)", 3.0),
    ("MOD(10, 3)", 1),
    ("POW(2, 3) + POWER(2, 0)", 9.0),
    ("SQRT(16)", 4.0),
    ("GREATEST(1, 2.5, 2)", 2.5),
    ("LEAST(1, NULL)", None),
    ("GREATEST('a')", "a"),
    ("IFNULL(NULL, 2)", 2),
    ("ISNULL(1, 2)", 1),
    ("COALESCE(NULL, NULL, 'x')", "x"),
    ("DATE('2026/5/7 10:00')", "2026-05-07"),
    ("DATE('nope')", "nope"),
    ("DATE('2026-13-01')", "2026-13-01"),
    ("NOW() > '2020-01-01'", True),
    ("'it''s'", "it's"),
]


def test_scalars(engine):
    """All in one query, so the plan is analysed once."""
    got = rows(engine, "SELECT " + ", ".join(f"{sql} AS x{k}" for k, (sql, _) in enumerate(SCALARS)))[0]
    assert [(sql, g) for (sql, w), g in zip(SCALARS, got, strict=True) if g != w or type(g) is not type(w)] == []


UNSUPPORTED = [
    "SELECT 1 UNION SELECT 2",
    "SELECT * FROM (SELECT 1) t",
    "SELECT (SELECT 1)",
    "SELECT 1 WHERE 1 IN (SELECT 1)",
    "SELECT EXISTS (SELECT 1)",
    "WITH a AS (SELECT 1) SELECT * FROM a",
    "SELECT COUNT(*) OVER () FROM people",
    "SELECT DISTINCT ON (id) id FROM people",
    "SELECT city FROM people GROUP BY ALL",
    "SELECT city FROM people GROUP BY city WITH ROLLUP",
    "SELECT city FROM people ORDER BY ALL",
    "SELECT * FROM people NATURAL JOIN orders",
    "INSERT INTO people VALUES (1)",
    "DELETE FROM people",
    "SELECT COUNT(*) FILTER (WHERE id > 1) FROM people",
    "SELECT CAST(1 AS DATE)",
]


@pytest.mark.parametrize("sql", UNSUPPORTED)
def test_unsupported(engine, sql):
    with pytest.raises(UnsupportedError):
        engine.sql(sql)


WRONG = [
    "SELECT nope FROM people",
    "SELECT * FROM nope",
    "SELECT id FROM people a JOIN people b ON a.id = b.id",
    "SELECT p.nope FROM people p",
    "SELECT x.* FROM people",
    "SELECT name + 1 FROM people",
    "SELECT SUM(name) FROM people",
    "SELECT nope(1)",
    "SELECT LEN()",
    "SELECT 1 FROM people WHERE COUNT(*) > 1",
    "SELECT SUM(COUNT(*)) FROM people",
    "SELECT 1; SELECT 2",
    "SELECT",
    "SELECT 1 +",
    "",
    "SELECT id FROM people LIMIT id",
]


@pytest.mark.parametrize("sql", WRONG)
def test_wrong(engine, sql):
    with pytest.raises(QueryError):
        engine.sql(sql)


@pytest.mark.parametrize("sql", ["SELECT 1 / 0", "SELECT 1 % 0", "SELECT 9223372036854775807 + 1", "SELECT SQRT(-1)", "SELECT CAST('x' AS INT)", "SELECT CAST('maybe' AS BOOLEAN)"])
def test_errors_at_run_time(engine, sql):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        rows(engine, sql)


def test_titles(engine):
    got = engine.run("SELECT p.name, COUNT(*), p.age+1 x, *, 'a' FROM people p JOIN orders o ON p.id = o.customer_id GROUP BY p.id", stats=False)
    assert got.columns == ["p.name", "COUNT(*)", "x", "id", "name", "age", "city", "order_id", "customer_id", "amount", "'a'"]


def test_statistics(engine):
    stats = engine.run("SELECT * FROM people, orders WHERE id = 1 LIMIT 2").stats
    assert (stats.input_rows, stats.output_rows) == (15, 2)
    assert engine.run("SELECT 1").stats.input_rows == 1


def test_compat(spark, engine):
    e = Engine(spark, compat=True)
    e.register("a", spark.createDataFrame([(None,), (1,)], "k long"))
    e.register("b", spark.createDataFrame([(None,), (2,)], "k long"))
    assert rows(e, "SELECT COUNT(*) FROM a JOIN b ON a.k = b.k") == [(1,)]
    assert rows(e, "SELECT COUNT(*) FROM a JOIN b USING (k)") == [(1,)]
    assert rows(e, "SELECT 'Alice' LIKE 'li', NULL IS FALSE") == [(True, True)]


def test_nan_is_left_out_of_sums(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(float("nan"),), (1.5,), (None,), (0.5,)], "v double"))
    assert rows(e, "SELECT SUM(v), AVG(v), COUNT(v) FROM t") == [(2.0, 1.0, 3)]


def test_metadata(spark, engine):
    e = Engine(spark)
    e.register("商品销售", spark.createDataFrame([("a", 1)], ["商品", "金额"]), "sales_db")
    e.register("t", spark.createDataFrame([(True, 1.5)], "b boolean, f double"), "other_db")
    assert rows(e, "SHOW DATABASES") == [("sales_db",), ("other_db",)]
    assert rows(e, "SHOW SCHEMAS LIKE 'oth%'") == [("other_db",)]
    assert rows(e, "SHOW TABLES FROM other_db") == [("t",)]
    assert rows(e, "SHOW TABLES LIKE '商'") == [("商品销售",)]
    assert rows(e, "DESCRIBE t") == [("b", "Boolean"), ("f", "Float")]
    assert rows(e, "SHOW COLUMNS FROM `商品销售`") == [("商品", "Text"), ("金额", "Integer")]
    assert rows(e, "SELECT `商品`, SUM(金额) FROM 商品销售 GROUP BY 商品") == [("a", 1)]
    assert rows(e, "USE other_db") == [("Database changed",)]
    assert rows(e, "SHOW TABLES") == [("t",)]
    with pytest.raises(QueryError):
        e.sql("USE nope")
    e.register("t", spark.createDataFrame([(1,)], "x long"), "sales_db")
    e.catalog.current = None
    with pytest.raises(QueryError, match="ambiguous"):
        e.sql("SELECT * FROM t")
    assert rows(e, "SELECT x FROM sales_db.t") == [(1,)]


def test_outfile(engine, tmp_path):
    path = tmp_path / "out.csv"
    assert rows(engine, f"SELECT id, v, 1.0 AS f FROM people LEFT JOIN gaps ON id = k WHERE id < 4 ORDER BY id INTO OUTFILE '{path}'") == [(f"Written 3 row(s) to '{path}'",)]
    assert path.read_text() == "id,v,f\n1,NULL,1\n2,y,1\n3,NULL,1\n"
    with pytest.raises(QueryError, match="already exists"):
        engine.sql(f"SELECT 1 INTO OUTFILE '{path}'")


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 AS twice", "cast(id AS string) AS s", "timestamp_ntz '2020-01-01' AS t").write.parquet(f"{tmp_path}/t.parquet")
    e = Engine(spark).load_dir(str(tmp_path), ["t"])
    plan = plan_of(e.sql("SELECT twice FROM t WHERE id BETWEEN 10 AND 20 AND s LIKE '1%' AND t >= '2019-5-1' AND id IN (12, 13)"))
    for wanted in ("GreaterThanOrEqual(id,10)", "LessThanOrEqual(id,20)", "StringStartsWith(s,1)", "In(id, [12,13])", "GreaterThanOrEqual(t,2019-05-01"):
        assert wanted in plan, wanted
    assert "ReadSchema: struct<id:bigint,twice:bigint,s:string,t:timestamp_ntz>" in plan
    assert "CartesianProduct" not in plan_of(e.sql("SELECT COUNT(*) FROM t a, t b WHERE a.id = b.twice"))


def test_like_against_a_reference_matcher():
    import random
    import re

    from tabulon.functions.semantics import pattern_regex

    def matches(text, pattern):
        if not pattern:
            return not text
        if pattern[0] == "%":
            return any(matches(text[k:], pattern[1:]) for k in range(len(text) + 1))
        return bool(text) and pattern[0] in ("_", text[0]) and matches(text[1:], pattern[1:])

    pick = random.Random(3)
    for _ in range(2000):
        text = "".join(pick.choice("ab.\\\n") for _ in range(pick.randint(0, 6)))
        pattern = "".join(pick.choice("ab.%_\\") for _ in range(pick.randint(0, 5)))
        assert bool(re.search(pattern_regex(pattern).replace("\\z", "\\Z"), text)) == matches(text, pattern)


def test_numbers_beyond_int_and_bigint(engine):
    got = rows(engine, "SELECT FLOOR(1e300), CEIL(1e19), FLOOR(-2.5), CEIL(2.1), SUBSTRING('abc', 3000000000), SUBSTRING('abc', 2, 3000000000), SUBSTRING('abc', -3000000000), LEFT('abc', 3000000000), SPLIT('a.b', '.', 3000000000)")
    assert got == [(1e300, 1e19, -3.0, 3.0, "", "bc", "abc", "abc", None)]


def test_case_null_meets_null_only_in_compat(spark, engine):
    sql = "SELECT CASE NULL WHEN NULL THEN 1 ELSE 0 END, CASE v WHEN NULL THEN 1 WHEN 'x' THEN 2 ELSE 0 END FROM gaps WHERE k IS NULL ORDER BY v NULLS FIRST"
    assert rows(engine, sql) == [(0, 0), (0, 2)]
    e = Engine(spark, compat=True)
    e.register("gaps", engine.catalog.table(("gaps",)).frame)
    assert rows(e, sql) == [(1, 1), (1, 2)]


def test_statistics_never_multiply_a_comma_list_out(spark, engine):
    e = Engine(spark)
    for name in ("a", "b", "c", "d"):
        e.register(name, spark.range(50_000).withColumnRenamed("id", "x"))
    assert e.run("SELECT COUNT(*) FROM a, b, c, d WHERE a.x = b.x AND b.x = c.x AND c.x = d.x").stats.input_rows == 50_000**4
    assert e.run("SELECT COUNT(*) FROM a, b JOIN c ON b.x = c.x WHERE a.x = b.x").stats.input_rows == 50_000**2
    assert engine.run("SELECT COUNT(*) FROM people p, orders o JOIN people q ON q.id = p.id AND o.customer_id = q.id").stats.input_rows == 3
    assert engine.run("SELECT name FROM people WHERE age > 28 LIMIT 1").stats.input_rows == 5


def test_tables_are_read_when_named(spark):
    e = Engine(spark)
    e.register("never", lambda: 1 / 0)
    e.register("t", lambda: spark.range(3))
    assert rows(e, "SELECT COUNT(*) FROM t") == [(3,)]
    assert rows(e, "SHOW TABLES") == [("never",), ("t",)]


def test_first_rows_of_groups_survive_shuffles(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = Engine(spark)
        left = [(k, (k * 37) % 101, f"l{k}") for k in range(300)]
        right = [(k, (k * 53) % 101, f"r{k}") for k in range(200)]
        e.register("a", spark.createDataFrame(left, "i long, x long, s string").repartition(1).sortWithinPartitions("i"))
        e.register("b", spark.createDataFrame(right, "j long, x long, t string").repartition(1).sortWithinPartitions("j"))
        wanted = {}
        for _, x, s in left:
            for _, y, t in right:
                if x == y:
                    wanted.setdefault(x % 7, (s, t))
        got = rows(e, "SELECT a.x % 7 AS g, s, t FROM a, b WHERE a.x = b.x GROUP BY a.x % 7")
        assert {g: (s, t) for g, s, t in got} == wanted
        assert rows(e, "SELECT s, t, COUNT(*) FROM a RIGHT JOIN b ON a.x = b.x AND a.i < 0") == [(None, "r0", 200)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
