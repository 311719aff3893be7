"""Runs a SELECT continuously. The engine's plans are DataFrames, so a streaming table needs no other compiler."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tabulon.errors import UnsupportedError
from tabulon.session import Engine


def register_csv_folder(engine: Engine, name: str, folder: str, schema: StructType | str, **options: str) -> None:
    """A table of all CSV files that a folder has or gets; a stream's types must be given."""
    engine.register(name, engine.spark.readStream.schema(schema).options(**{"header": "true", **options}).csv(folder))


def writer(engine: Engine, sql: str) -> DataStreamWriter:
    """The statement's stream, to be given a sink, trigger and checkpoint: all groups again, or new rows."""
    frame = engine.sql(sql)
    if not frame.isStreaming:
        raise UnsupportedError("The statement reads no streaming table")
    return frame.writeStream.outputMode("complete" if aggregates(frame) else "append")


def aggregates(frame: DataFrame) -> bool:
    """Whether the plan groups rows, so that a result row can change later."""
    return "Aggregate" in frame._jdf.queryExecution().analyzed().toString()
