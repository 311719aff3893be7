"""The engine: a catalog of tables, and statements over them."""

from __future__ import annotations

import glob
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tabulon.catalog import Catalog, Table
from tabulon.errors import LoadError, QueryError
from tabulon.functions.semantics import pattern_regex
from tabulon.naming import database_name, sanitise, table_name
from tabulon.plans.select import Plan, Planner
from tabulon.render import write_csv
from tabulon.sql import nodes as n
from tabulon.sql.parser import parse


@dataclass
class QueryStats:
    elapsed_ms: int = 0
    input_rows: int = 0
    output_rows: int = 0


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    stats: QueryStats = field(default_factory=QueryStats)


class Engine:
    """Loads files or registers DataFrames, and runs MySQL-flavoured read-only statements on them.

    compat=True also reproduces what is unusual and undocumented: NULL keys meet in pure equi-joins, LIKE
    without wildcards searches for a substring, and NULL IS FALSE is true.
    """

    def __init__(self, spark: SparkSession, compat: bool = False):
        self.spark, self.compat, self.catalog = spark, compat, Catalog()

    # tables
    def load(self, paths: list[str] | str, max_rows: int | None = None, max_bytes: int | None = None, delimiter: str = ",", header: bool = True, null_value: str | None = None) -> Engine:
        """Loads CSV, XLS, XLSX and XLSM files, one database each. A single file becomes the current database."""
        from tabulon.sources import load_file

        found = expand(paths)
        for path in found:
            check_file(path, max_bytes)
        for path in found:
            database = self.catalog.add(database_name(path))
            for name, frame, labels in load_file(self.spark, path, max_rows=max_rows, delimiter=delimiter, header=header, null_value=null_value):
                database.add(name, frame, labels)
        if len(found) == 1:
            self.catalog.current = next(iter(self.catalog.databases))
        return self

    def register(self, name: str, frame: DataFrame | Callable[[], DataFrame], database: str = "main") -> Table:
        """A DataFrame, or a function that reads one when it is named, as a table; the first database registered becomes the current one."""
        target = self.catalog.databases.get(database) or self.catalog.add(database)
        if self.catalog.current is None:
            self.catalog.current = target.name
        return target.add(name, frame)

    def load_dir(self, directory: str, names: list[str], database: str = "main") -> Engine:
        """Registers <directory>/<name>.parquet for each name; a file's footer is read when a statement names it."""
        for name in names:
            self.register(name, partial(self.spark.read.parquet, f"{directory}/{name}.parquet"), database)
        return self

    # statements
    def sql(self, text: str) -> DataFrame:
        """A statement's result as a lazy DataFrame; INTO OUTFILE and USE act at once."""
        return self.planned(text).frame

    def run(self, text: str, stats: bool = True) -> QueryResult:
        """A statement's result as rows, with statistics."""
        began = time.perf_counter()
        plan = self.planned(text)
        rows = [tuple(r) for r in plan.frame.collect()]
        taken = plan.taken() if stats and plan.taken else 0
        return QueryResult(plan.titles, rows, QueryStats(int((time.perf_counter() - began) * 1000), taken, len(rows)))

    def planned(self, text: str) -> Plan:
        node = parse(text)
        if isinstance(node, n.Show):
            return self.shown(node)
        if isinstance(node, n.Use):
            self.catalog.use(node.database)
            return self.small(["Status"], [("Database changed",)])
        plan = Planner(self.spark, self.catalog, self.compat).plan(node)
        if node.outfile is None:
            return plan
        if os.path.exists(node.outfile):
            raise QueryError(f"Output file '{node.outfile}' already exists")
        try:
            count = write_csv(node.outfile, plan.titles, (tuple(r) for r in plan.frame.toLocalIterator()))
        except OSError as error:
            raise QueryError(f"Cannot write file '{node.outfile}': {error}") from error
        return self.small(["Status"], [(f"Written {count} row(s) to '{node.outfile}'",)])

    def shown(self, node: n.Show) -> Plan:
        keep = lambda names: [x for x in names if node.like is None or matches(x, node.like)]
        if node.what == "databases":
            return self.small(["Database"], [(x,) for x in keep(self.catalog.databases)])
        if node.what == "tables":
            if not node.source and self.catalog.current is None:
                raise QueryError("No database selected")
            database = self.catalog.database(".".join(node.source) if node.source else self.catalog.current)
            return self.small(["Tables"], [(x,) for x in keep(database.tables)])
        return self.small(["Column", "Type"], self.catalog.table(node.source).described())

    def small(self, titles: list[str], rows: list[tuple]) -> Plan:
        frame = self.spark.createDataFrame(rows, ", ".join(f"`{t}` string" for t in titles))
        return Plan(frame, None, titles, ["text"] * len(titles))


def matches(name: str, pattern: str) -> bool:
    """LIKE of SHOW: without wildcards a search, and letter case doesn't count."""
    name, pattern = name.lower(), pattern.lower()
    if not re.search("[%_]", pattern):
        return pattern in name
    return re.fullmatch(pattern_regex(pattern).removeprefix("(?s)^").removesuffix("\\z"), name, re.DOTALL) is not None


SUPPORTED = (".csv", ".xls", ".xlsx", ".xlsm")


def expand(paths: list[str] | str) -> list[str]:
    """Paths with * ? [ expanded, each file once, in order."""
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if any(c in path for c in "*?[") and not os.path.exists(path):
            found = sorted(p for p in glob.glob(path) if os.path.isfile(p))
            if not found:
                raise LoadError(f"No files match `{path}`")
        else:
            found = [path]
        out += [p for p in found if p not in out]
    return out


def check_file(path: str, max_bytes: int | None = None) -> None:
    if Path(path).suffix.lower() not in SUPPORTED:
        raise LoadError(f"Unsupported file `{path}`; expected one of {', '.join(s[1:] for s in SUPPORTED)}")
    if "://" in path:
        return
    if not os.path.isfile(path):
        raise LoadError(f"File `{path}` does not exist")
    size = os.stat(path).st_size
    if max_bytes is not None and size > max_bytes:
        raise LoadError(f"File `{path}` has {size} bytes, more than the limit of {max_bytes}")


__all__ = ["Engine", "QueryResult", "QueryStats", "database_name", "sanitise", "table_name"]
