"""The syntax tree. Nodes are frozen, so equal expressions compare equal, and print as SQL for titles."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


class Node:
    def children(self) -> list[Node]:
        found: list[Node] = []
        for f in fields(self):  # type: ignore[arg-type]
            gather(getattr(self, f.name), found)
        return found

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


def gather(value: Any, found: list) -> None:
    if isinstance(value, Node):
        found.append(value)
    elif isinstance(value, tuple):
        for x in value:
            gather(x, found)


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    kind: str  # int, float, text, bool, null
    raw: str = ""

    def __str__(self) -> str:
        if self.kind == "text":
            return "'" + self.value.replace("'", "''") + "'"
        return self.raw or str(self.value)


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]
    #: Made by a star: the part is a plan's own column name.
    direct: bool = False

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.*" if self.table else "*"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    value: Node

    def __str__(self) -> str:
        return f"NOT {self.value}" if self.op == "NOT" else f"{self.op}{self.value}"


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Nested(Node):
    value: Node

    def __str__(self) -> str:
        return f"({self.value})"


@dataclass(frozen=True)
class Is(Node):
    value: Node
    what: str  # NULL, TRUE, FALSE
    negated: bool

    def __str__(self) -> str:
        return f"{self.value} IS {'NOT ' * self.negated}{self.what}"


@dataclass(frozen=True)
class In(Node):
    value: Node
    items: tuple[Node, ...]
    negated: bool

    def __str__(self) -> str:
        return f"{self.value} {'NOT ' * self.negated}IN ({', '.join(map(str, self.items))})"


@dataclass(frozen=True)
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool

    def __str__(self) -> str:
        return f"{self.value} {'NOT ' * self.negated}BETWEEN {self.low} AND {self.high}"


@dataclass(frozen=True)
class Like(Node):
    value: Node
    pattern: Node
    escape: str | None
    negated: bool
    fold: bool

    def __str__(self) -> str:
        return f"{self.value} {'NOT ' * self.negated}{'ILIKE' if self.fold else 'LIKE'} {self.pattern}" + (f" ESCAPE '{self.escape}'" if self.escape is not None else "")


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None

    def __str__(self) -> str:
        head = f"CASE {self.operand}" if self.operand else "CASE"
        return head + "".join(f" WHEN {c} THEN {r}" for c, r in self.branches) + (f" ELSE {self.otherwise}" if self.otherwise else "") + " END"


@dataclass(frozen=True)
class Cast(Node):
    value: Node
    type: str
    shown: str
    short: bool = False

    def __str__(self) -> str:
        return f"{self.value}::{self.shown}" if self.short else f"CAST({self.value} AS {self.shown})"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    shown: str = ""

    def __str__(self) -> str:
        return self.shown or f"{self.name}({'DISTINCT ' * self.distinct}{', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None


@dataclass(frozen=True)
class Relation(Node):
    parts: tuple[str, ...]
    alias: str | None


@dataclass(frozen=True)
class Join(Node):
    kind: str  # inner, left, right, full, cross
    right: Relation
    on: Node | None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class From(Node):
    first: Relation
    joins: tuple[Join, ...]


@dataclass(frozen=True)
class Order(Node):
    value: Node
    ascending: bool
    nulls_first: bool | None


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Node, ...]
    distinct: bool
    sources: tuple[From, ...]
    where: Node | None
    group: tuple[Node, ...]
    having: Node | None
    order: tuple[Order, ...]
    limit: Node | None
    offset: Node | None
    outfile: str | None


@dataclass(frozen=True)
class Show(Node):
    what: str  # databases, tables, columns
    source: tuple[str, ...] = ()
    like: str | None = None


@dataclass(frozen=True)
class Use(Node):
    database: str
