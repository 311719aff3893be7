"""Databases and their tables, in order of loading, and the current database."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from tabulon.errors import QueryError
from tabulon.functions.semantics import kind_of
from tabulon.naming import unique

LABELS = {"int": "Integer", "float": "Float", "bool": "Boolean"}


@dataclass
class Table:
    name: str
    #: The rows, or what reads them when a statement first names the table.
    made: DataFrame | Callable[[], DataFrame]
    #: Type labels by column where the source knows better than the Spark type.
    labels: dict[str, str] = field(default_factory=dict)

    @cached_property
    def frame(self) -> DataFrame:
        return self.made() if callable(self.made) else self.made

    @cached_property
    def rows(self) -> int:
        """Number of rows, counted once; of Parquet it is read from the footers."""
        return self.frame.count()

    def described(self) -> list[tuple[str, str]]:
        return [(f.name, self.labels.get(f.name) or LABELS.get(kind_of(f.dataType), "Text")) for f in self.frame.schema.fields]


@dataclass
class Database:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, name: str, frame: DataFrame | Callable[[], DataFrame], labels: dict[str, str] | None = None) -> Table:
        name = unique(name, self.tables)
        self.tables[name] = Table(name, frame, labels or {})
        return self.tables[name]


class Catalog:
    def __init__(self) -> None:
        self.databases: dict[str, Database] = {}
        self.current: str | None = None

    def add(self, name: str) -> Database:
        name = unique(name, self.databases)
        self.databases[name] = Database(name)
        return self.databases[name]

    def use(self, name: str) -> None:
        self.current = self.database(name).name

    def database(self, name: str) -> Database:
        found = self.databases.get(name) or self.databases.get(name.lower())
        if found is None:
            raise QueryError(f"Unknown database {name}")
        return found

    def table(self, parts: tuple[str, ...]) -> Table:
        """A table by name, in the current database first, or by database and name."""
        if len(parts) > 2:
            raise QueryError(f"Table name {'.'.join(parts)} has too many parts")
        name = parts[-1]
        look = lambda d: d.tables.get(name) or d.tables.get(name.lower())
        if len(parts) == 2:
            found = look(self.database(parts[0]))
            if found is None:
                raise QueryError(f"Table {'.'.join(parts)} not found")
            return found
        if self.current and (found := look(self.databases[self.current])):
            return found
        hits = [(d.name, t) for d in self.databases.values() if (t := look(d))]
        if not hits:
            raise QueryError(f"Table {name} not found")
        if len(hits) > 1:
            raise QueryError(f"Table {name} is ambiguous; it is in {', '.join(d for d, _ in hits)}")
        return hits[0][1]
