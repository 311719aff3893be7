"""Files as tables: (name, DataFrame, type labels) of each table in a file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from tabulon.naming import table_name


def load_file(spark: SparkSession, path: str, max_rows: int | None = None, delimiter: str = ",", header: bool = True, null_value: str | None = None) -> Iterator[tuple[str, DataFrame, dict[str, str]]]:
    kind = PurePath(path).suffix.lower()
    if kind == ".csv":
        from tabulon.sources.csv import read_csv

        found = read_csv(spark, path, max_rows, delimiter, header, null_value)
        if found is not None:
            yield table_name(path), *found
        return
    from tabulon.sources.sheets import frame_of

    if kind == ".xls":
        from tabulon.sources.xls import sheets
    else:
        from tabulon.sources.xlsx import sheets
    from tabulon.naming import sanitise

    for name, rows in sheets(path):
        made = frame_of(spark, path, rows, max_rows)
        if made is not None:
            yield sanitise(name), *made
