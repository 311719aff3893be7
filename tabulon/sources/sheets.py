"""Sheets of workbooks as DataFrames. A sheet's cells are Python values; workbook formats bound its rows."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.errors import LoadError
from tabulon.naming import column_names
from tabulon.render import shown

TYPES = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "text": T.StringType()}
LABELS = {"int": "Integer", "float": "Float", "bool": "Boolean"}
# Number formats that stand for dates or times without a definition of their own.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def is_date_format(code: str) -> bool:
    """Whether a number format shows dates: day, month, year, hour or second letters outside quotes and brackets."""
    import re

    return bool(re.search("[dmyhsDMYHS]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code.split(";")[0])))


def from_serial(value: float, base_1904: bool = False) -> datetime.date | datetime.datetime:
    """A day number as a date, or with the time where it isn't midnight; to the second."""
    day = datetime.datetime(1904, 1, 1) if base_1904 else datetime.datetime(1899, 12, 30)
    at = day + datetime.timedelta(seconds=round(value * 86400))
    return at.date() if (at.hour, at.minute, at.second) == (0, 0, 0) else at


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, datetime.datetime):
        return "datetime"
    return "date" if isinstance(value, datetime.date) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "text"


def settled(kinds: set[str]) -> tuple[str, str]:
    label = "Text" if not kinds or kinds & {"text", "date", "datetime"} else next(LABELS[k] for k in ("bool", "float", "int") if k in kinds)
    if len(kinds) == 1:
        return next(iter(kinds)), label
    if kinds and kinds <= {"int", "float"}:
        return "float", label
    return ("datetime" if kinds and kinds <= {"date", "datetime"} else "text"), label


def converted(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == "float":
        return float(value)
    if kind == "datetime" and not isinstance(value, datetime.datetime):
        return datetime.datetime.combine(value, datetime.time())
    return shown(value) if kind == "text" and not isinstance(value, str) else value


def frame_of(spark: SparkSession, path: str, rows: list[list[Any]], max_rows: int | None = None) -> tuple[DataFrame, dict[str, str]] | None:
    """(DataFrame, labels) of a sheet, or None if it has no cells. The first row is the header; cells beyond it are dropped."""
    rows = [r for r in rows if any(c is not None and c != "" for c in r)]
    if not rows:
        return None
    names = column_names([None if c is None else shown(c) for c in rows[0]])
    data = [[None if c == "" else c for c in r[: len(names)]] for r in rows[1:]]
    data = [[*r, *[None] * (len(names) - len(r))] for r in data]
    data = [r for r in data if any(c is not None for c in r)]
    if max_rows is not None and len(data) > max_rows:
        raise LoadError(f"{path}: more than {max_rows} rows")
    settles = [settled({kind_of(r[k]) for r in data if r[k] is not None}) for k in range(len(names))]
    schema = T.StructType([T.StructField(n, TYPES[kind]) for n, (kind, _) in zip(names, settles, strict=True)])
    made = [tuple(converted(c, kind) for c, (kind, _) in zip(r, settles, strict=True)) for r in data]
    return spark.createDataFrame(made, schema), {n: label for n, (_, label) in zip(names, settles, strict=True)}
