"""Which columns a name can mean. Inside a plan columns have positional names, so any titles may repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from tabulon.errors import QueryError
from tabulon.functions.semantics import Typed
from tabulon.sql.nodes import Name


@dataclass(frozen=True)
class Field:
    table: str
    alias: str | None
    name: str
    column: str
    kind: str

    def typed(self) -> Typed:
        return Typed(F.col(self.column), self.kind)

    def belongs(self, table: str) -> bool:
        return table.lower() in (self.table.lower(), (self.alias or self.table).lower())


class Scope:
    def __init__(self, fields: list[Field]):
        self.fields = fields

    def find(self, parts: tuple[str, ...]) -> Field | None:
        """The field that the name means, None if there is none; more than one is an error."""
        *head, name = parts
        hits = self.hits(head, name, exact=True) or self.hits(head, name, exact=False)
        if len(hits) > 1:
            raise QueryError(f"Column {'.'.join(parts)} is ambiguous")
        return hits[0] if hits else None

    def hits(self, head: list[str], name: str, exact: bool) -> list[Field]:
        same = (lambda a, b: a == b) if exact else (lambda a, b: a.lower() == b.lower())
        found = [f for f in self.fields if same(f.name, name)]
        if head:
            found = [f for f in found if f.belongs(head[-1])]
        return found

    def field(self, parts: tuple[str, ...]) -> Field:
        found = self.find(parts)
        if found is None:
            raise QueryError(f"Unknown column {'.'.join(parts)}")
        return found

    def of(self, node: Name) -> Field:
        if node.direct:
            return next(f for f in self.fields if f.column == node.parts[0])
        return self.field(node.parts)

    def of_table(self, table: str) -> list[Field]:
        found = [f for f in self.fields if f.belongs(table)]
        if not found:
            raise QueryError(f"Unknown table {table}")
        return found
