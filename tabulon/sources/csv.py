"""CSV files by Spark's reader: cells as text, then one pass that types all columns and checks the rows."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import LoadError
from tabulon.naming import column_names
from tabulon.sources.infer import seen, settled, typed


def odd_quotes() -> Column:
    """1 for a line with an odd number of quotes, else 0."""
    return (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None, delimiter: str = ",", header: bool = True, null_value: str | None = None) -> tuple[DataFrame, dict[str, str]] | None:
    """(DataFrame, labels), or None for a file without records.

    Short rows are padded with NULL, rows of NULLs are skipped and a row longer than the header is an error.
    A file is split over tasks; where some line leaves a quote open, that is a record spans lines, `records` joins them first.
    """
    spans = not spark.read.text(path).filter(odd_quotes() == 1).isEmpty()
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnPruning": "false"}
    whole = records(spark, path) if spans else None
    if whole is None:
        first = spark.read.options(**options).csv(path).limit(1).collect()
    else:
        top = whole.orderBy("block", "at").limit(1).collect()
        first = [next(csv.reader(io.StringIO(r["value"], newline=""), delimiter=delimiter), []) for r in top]
    if not first or not len(first[0]):
        return None
    cells = [c if c is not None else "" for c in first[0]]
    names = column_names(list(cells)) if header else [f"col{k}" for k in range(1, len(cells) + 1)]
    plain = [f"c{k}" for k in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*plain, "__bad"]])
    options["columnNameOfCorruptRecord"] = "__bad"
    if whole is None:
        rows = spark.read.options(**options).option("header", str(header).lower()).schema(schema).csv(path)
    else:
        if header:
            whole = whole.filter((F.col("block") != top[0]["block"]) | (F.col("at") != top[0]["at"]))
        shape = ", ".join(f"`{c}` string" for c in schema.names)
        rows = whole.select(F.from_csv("value", shape, options).alias("row")).select("row.*")
    if null_value is not None:
        rows = rows.select(*[F.when(F.col(c) != null_value, F.col(c)).alias(c) for c in plain], "__bad")
    bare = F.regexp_replace("__bad", r'"([^"]|"")*"', "")
    long = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) >= len(names), F.lit(False))
    empty = F.lit(True)
    for c in plain:
        empty = empty & (F.col(c).isNull() | (F.col(c) == ""))
    checks = rows.agg(*[seen(F.col(c)).alias(c) for c in plain], F.max(long).alias("__long"), F.count(F.when(~empty, 1)).alias("__rows")).first()
    if checks["__long"]:
        raise LoadError(f"{path}: {too_long(spark, path, delimiter, len(names))}")
    if max_rows is not None and checks["__rows"] > max_rows:
        raise LoadError(f"{path}: more than {max_rows} rows")
    settles = [settled(checks[c]) for c in plain]
    columns = [typed(F.col(c), kind, mixed=kind == "text" and bin(checks[c]).count("1") > 1).alias(name) for c, name, (kind, _) in zip(plain, names, settles, strict=True)]
    return rows.filter(~empty).select(*columns), {name: label for name, (_, label) in zip(names, settles, strict=True)}


def records(spark: SparkSession, path: str) -> DataFrame:
    """(block, at, value): a CSV file's records, also those that span lines, in as many tasks as the file has blocks.

    A line begins a record if the quotes before it are even in number. Two passes tell each block of the file how many
    quotes lie before it and which record reaches into it; the driver gets two numbers a block. Lines of records
    that span lines are then brought together; all others stay where they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("odd", odd_quotes().cast("int"))
    ahead, total = [], 0
    for r in lines.groupBy("block").agg(F.sum("odd").alias("n")).orderBy("block").collect():
        ahead.append((r["block"], total % 2))
        total += r["n"]
    within = Window.partitionBy("block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(F.broadcast(spark.createDataFrame(ahead, "block long, ahead int")), "block").withColumn("begins", (F.col("ahead") + before) % 2 == 0)
    begun = F.last(F.when(F.col("begins"), F.struct("block", "at")), ignorenulls=True).over(within)
    lines = lines.withColumn("record", begun)
    carried, held = [], None
    for r in lines.groupBy("block").agg(F.max("record").alias("last")).orderBy("block").collect():
        carried.append((r["block"], held))
        held = r["last"] or held
    kinds = "block long, carried struct<block: long, at: long>"
    lines = lines.join(F.broadcast(spark.createDataFrame(carried, kinds)), "block").withColumn("record", F.coalesce("record", "carried"))
    alone = lines.filter(F.col("begins") & (F.col("odd") == 0)).select("block", "at", F.regexp_replace("value", "\r$", "").alias("value"))
    # a line that begins a record of several, or goes on with one; lines before any record never occur
    parts = lines.filter(~F.col("begins") | (F.col("odd") == 1)).groupBy("record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    joined = parts.select("record.block", "record.at", F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["value"]), "\n"), "\r$", "").alias("value"))
    return alone.unionByName(joined)


def too_long(spark: SparkSession, path: str, delimiter: str, most: int) -> str:
    """The message for the first record that is too long; it streams the file through the driver up to there."""
    at = 0

    def lines():
        nonlocal at
        for row in spark.read.text(path, wholetext=False).toLocalIterator():
            at += 1
            yield row[0] + "\n"

    for record in csv.reader(lines(), delimiter=delimiter):
        if len(record) > most:
            return f"line {at} has {len(record)} fields, the header has {most}"
    return re.sub(r"\s+", " ", f"a row has more fields than the header's {most}")
