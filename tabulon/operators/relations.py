"""FROM: tables, comma products and joins, over positional columns."""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.catalog import Catalog
from tabulon.errors import QueryError
from tabulon.functions.semantics import NUMBERS, Typed, column, compare
from tabulon.plans.lower import Lowering, both
from tabulon.plans.scope import Field, Scope
from tabulon.sql import nodes as n


class Relations:
    """Builds the FROM clause of one query; column names count up over all its tables.

    numbered: each table's rows get a number as they are scanned, in the columns `numbers`.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, compat: bool, numbered: bool = False):
        self.spark, self.catalog, self.compat, self.used = spark, catalog, compat, 0
        self.numbered, self.numbers = numbered, []

    def build(self, sources: tuple[n.From, ...]) -> tuple[DataFrame, Scope]:
        if not sources:
            return self.spark.range(1).select(), Scope([])
        frame, scope = None, Scope([])
        for source in sources:
            frame, scope = self.joined(frame, scope, source.first, None)
            for join in source.joins:
                frame, scope = self.joined(frame, scope, join.right, join)
        return frame, scope

    def rows(self, sources: tuple[n.From, ...]) -> int:
        """The number of rows of FROM; a comma list's is a product, so it is never multiplied out to count it.

        A table's rows are counted once. Only a JOIN is run for its count, with what its condition names.
        """
        out: list[Callable[[], int]] = []
        apart: list[n.From] = []
        for source in sources:
            apart.append(source)
            if not source.joins:
                table = self.catalog.table(source.first.parts)
                out.append(lambda table=table: table.rows)
                continue
            try:
                frame, _ = Relations(self.spark, self.catalog, self.compat).build((source,))
            except QueryError:  # its condition names tables before the comma
                frame, _ = Relations(self.spark, self.catalog, self.compat).build(tuple(apart))
                out = []
            out.append(frame.count)
        return prod(count() for count in out)

    def relation(self, node: n.Relation) -> tuple[DataFrame, list[Field]]:
        table = self.catalog.table(node.parts)
        fields, columns = [], []
        for f in table.frame.schema.fields:
            typed = column(table.frame[f"`{f.name.replace('`', '``')}`"], f.dataType)
            fields.append(Field(table.name, node.alias, f.name, f"c{self.used}", typed.kind))
            columns.append(typed.col.alias(f"c{self.used}"))
            self.used += 1
        if self.numbered:
            self.numbers.append(f"r{len(self.numbers)}")
            columns.append(F.monotonically_increasing_id().alias(self.numbers[-1]))
        return table.frame.select(*columns), fields

    def joined(self, left: DataFrame | None, scope: Scope, relation: n.Relation, join: n.Join | None) -> tuple[DataFrame, Scope]:
        right, fields = self.relation(relation)
        if left is None:
            return right, Scope(fields)
        both_sides = Scope([*scope.fields, *fields])
        if join is None or (join.on is None and not join.using):
            return left.crossJoin(right), both_sides
        if join.using:
            condition = both([self.equal(self.one(scope, c), self.one(Scope(fields), c)) for c in join.using])
        else:
            condition = self.equi(join.on, scope, Scope(fields), both_sides)
            if condition is None:
                condition = Lowering(both_sides, compat=self.compat).condition(join.on)
        how = {"cross": "inner"}.get(join.kind, join.kind)
        return left.join(right, condition, how), both_sides

    def one(self, scope: Scope, name: str) -> Typed:
        found = scope.find((name,))
        if found is None:
            raise QueryError(f"Column {name} of USING not found")
        return found.typed()

    def equal(self, a: Typed, b: Typed):
        alike = a.kind == b.kind or (a.kind in NUMBERS and b.kind in NUMBERS)
        return a.col.eqNullSafe(b.col) if self.compat and alike else compare("=", a, b)

    def equi(self, node: n.Node, left: Scope, right: Scope, every: Scope):
        """An AND of column = column between the sides, in the compatible mode, where NULL keys meet."""
        if not self.compat:
            return None
        if isinstance(node, n.Binary) and node.op == "AND":
            a, b = self.equi(node.left, left, right, every), self.equi(node.right, left, right, every)
            return None if a is None or b is None else a & b
        if not (isinstance(node, n.Binary) and node.op == "=" and isinstance(node.left, n.Name) and isinstance(node.right, n.Name)):
            return None
        x, y = every.field(node.left.parts), every.field(node.right.parts)
        if (x in left.fields) == (y in left.fields):
            return None
        return self.equal(x.typed(), y.typed())

