"""From a SELECT statement to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.catalog import Catalog
from tabulon.errors import QueryError
from tabulon.functions.aggregates import aggregate
from tabulon.functions.semantics import Typed, truthy
from tabulon.operators.relations import Relations
from tabulon.plans.lower import Lowering, has_aggregate, is_aggregate, is_constant
from tabulon.plans.scope import Scope
from tabulon.sql import nodes as n


@dataclass
class Output:
    title: str
    value: Typed
    node: n.Node


@dataclass
class Plan:
    frame: DataFrame
    #: Counts the rows after FROM and JOIN, before WHERE, for statistics; None for statements without tables.
    taken: Callable[[], int] | None
    titles: list[str]
    kinds: list[str]


class Grouping:
    """Keys, aggregates and first-row values of a grouped query, and how expressions above refer to them."""

    def __init__(self, scope: Scope, keys: tuple[n.Node, ...], compat: bool):
        self.scope, self.lower = scope, Lowering(scope, compat=compat)
        self.keys: dict[object, tuple[str, Typed]] = {}
        self.grouped = bool(keys)
        for k in keys:
            if has_aggregate(k):
                raise QueryError(f"{k} is not allowed in GROUP BY")
            if not is_constant(k):
                self.keys.setdefault(self.signature(k), (f"g{len(self.keys)}", self.lower(k)))
        self.aggregates: dict[object, tuple[str, Typed]] = {}
        self.firsts: dict[str, str] = {}

    def signature(self, node: n.Node) -> object:
        """Equal for expressions that mean the same columns, however they spell them."""
        if isinstance(node, n.Nested):
            return self.signature(node.value)
        if isinstance(node, n.Name):
            return "column", self.scope.of(node).column
        if isinstance(node, n.Call):
            return "call", node.name.upper(), node.distinct, tuple(self.signature(a) for a in node.args)
        values = [v for k, v in vars(node).items() if k not in ("raw", "shown")]
        return type(node).__name__, tuple(self.part(v) for v in values)

    def part(self, value: object) -> object:
        if isinstance(value, n.Node):
            return self.signature(value)
        return tuple(self.part(v) for v in value) if isinstance(value, tuple) else (type(value).__name__, value)

    def replace(self, node: n.Node) -> Typed | None:
        if is_aggregate(node):
            return self.aggregated(node)
        if isinstance(node, (n.Literal, n.Star)):
            return None
        if isinstance(node, n.Name) and not node.direct and self.scope.find(node.parts) is None:
            return None
        if not has_aggregate(node) and (found := self.keys.get(self.signature(node))):
            return Typed(F.col(found[0]), found[1].kind)
        if isinstance(node, n.Name):
            field = self.scope.of(node)
            return Typed(self.first(field.column), field.kind)
        return None

    def aggregated(self, node: n.Call) -> Typed:
        if not node.args:
            raise QueryError(f"{node.name} needs an argument")
        arg = node.args[0]
        if any(has_aggregate(a) for a in node.args):
            raise QueryError(f"Aggregates can't be nested: {node}")
        key = self.signature(node)
        if key not in self.aggregates:
            value = aggregate(node.name, None if isinstance(arg, n.Star) else self.lower(arg), node.distinct)
            self.aggregates[key] = f"a{len(self.aggregates)}", value
        name, value = self.aggregates[key]
        return Typed(F.col(name), value.kind)

    def first(self, column: str) -> Column:
        """A column outside the keys: its value in the group's first row."""
        self.firsts.setdefault(column, column)
        return F.col(f"first.{column}")

    def apply(self, frame: DataFrame, numbers: list[str]) -> DataFrame:
        """numbers: of the tables' rows; a group's first row is the first of the first table, then of the second, whatever was shuffled since."""
        made = [v.col.alias(name) for name, v in self.aggregates.values()]
        if self.firsts:
            order = F.struct(F.lit(0), *[F.coalesce(r, F.lit(2**63 - 1)) for r in numbers])  # rows that an outer join adds come last
            made.append(F.min_by(F.struct(*self.firsts), order).alias("first"))
        if not self.grouped:
            return frame.agg(*(made or [F.count(F.lit(1)).alias("n")]))
        if not self.keys:  # constants only: one group, none of no rows
            frame = frame.withColumn("g", F.lit(1))
            return frame.groupBy("g").agg(*(made or [F.count(F.lit(1)).alias("n")]))
        frame = frame.select("*", *[v.col.alias(name) for name, v in self.keys.values()])
        names = [name for name, _ in self.keys.values()]
        return frame.groupBy(*names).agg(*made) if made else frame.select(*names).distinct()


def constant(node: n.Node | None) -> int | None:
    """The number that LIMIT or OFFSET gives: below 0 counts as 0, anything but a whole number as nothing."""
    if node is None:
        return None
    sign = 1
    while isinstance(node, (n.Nested, n.Unary)):
        if isinstance(node, n.Unary):
            sign = -sign if node.op == "-" else sign
        node = node.value
    if not isinstance(node, n.Literal):
        raise QueryError("LIMIT and OFFSET take constants")
    return max(sign * node.value, 0) if node.kind == "int" else None


class Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog, compat: bool = False):
        self.spark, self.catalog, self.compat = spark, catalog, compat

    def plan(self, node: n.Select) -> Plan:
        relations = Relations(self.spark, self.catalog, self.compat)
        frame, scope = self.filtered(node, relations)
        taken = partial(relations.rows, node.sources)
        nodes = self.expanded(node.items, scope)
        grouped = bool(node.group) or node.having is not None or any(has_aggregate(i.value) for i in nodes) or any(has_aggregate(o.value) for o in node.order)
        if grouped:
            return self.grouped(node, taken, frame, scope, nodes)
        lower = Lowering(scope, compat=self.compat)
        outputs = [Output(self.title(i), lower(i.value), i.value) for i in nodes]
        return self.finished(node, taken, frame, outputs, lower)

    def filtered(self, node: n.Select, relations: Relations) -> tuple[DataFrame, Scope]:
        """FROM and WHERE."""
        frame, scope = relations.build(node.sources)
        if node.where is not None:
            if has_aggregate(node.where):
                raise QueryError("Aggregates are not allowed in WHERE")
            frame = frame.filter(Lowering(scope, compat=self.compat).condition(node.where))
        return frame, scope

    def grouped(self, node: n.Select, taken: Callable[[], int], frame: DataFrame, scope: Scope, nodes: list[n.Item]) -> Plan:
        grouping = Grouping(scope, node.group, self.compat)
        lower = Lowering(scope, grouping.replace, self.compat)
        outputs = [Output(self.title(i), lower(i.value), i.value) for i in nodes]
        having = truthy(lower(node.having)) if node.having is not None else None
        for o in node.order:
            self.order_key(o.value, outputs, lower)
        numbers: list[str] = []
        if grouping.firsts:  # only then are rows numbered, which keeps filters from the scan
            relations = Relations(self.spark, self.catalog, self.compat, numbered=True)
            frame, _ = self.filtered(node, relations)
            numbers = relations.numbers
        frame = grouping.apply(frame, numbers)
        return self.finished(node, taken, frame if having is None else frame.filter(having), outputs, lower)

    def expanded(self, items: tuple[n.Node, ...], scope: Scope) -> list[n.Item]:
        out: list[n.Item] = []
        for item in items:
            if not isinstance(item, n.Star):
                out.append(item)
                continue
            fields = scope.fields if item.table is None else scope.of_table(item.table)
            if not fields:
                raise QueryError("SELECT * needs FROM")
            out += [n.Item(n.Name((f.column,), direct=True), f.name) for f in fields]
        return out

    def title(self, item: n.Item) -> str:
        return item.alias if item.alias is not None else str(item.value)

    def order_key(self, node: n.Node, outputs: list[Output], lower: Lowering) -> Output | Typed | None:
        """An output, a value from below, or None for a constant, which sorts nothing."""
        if isinstance(node, n.Nested):
            return self.order_key(node.value, outputs, lower)
        if isinstance(node, n.Name) and len(node.parts) == 1:
            hits = [o for o in outputs if o.title.lower() == node.parts[0].lower()]
            if hits:
                return hits[0]
        if isinstance(node, n.Name) and len(node.parts) > 1:
            hits = [o for o in outputs if o.title.lower() == str(node).lower()]
            if hits:
                return hits[0]
        if is_constant(node) and not has_aggregate(node):
            return None
        same = [o for o in outputs if o.node == node]
        if same:
            return same[0]

        def titled(x: n.Node) -> Typed | None:
            if isinstance(x, n.Name) and len(x.parts) == 1 and lower.scope.find(x.parts) is None:
                found = [o for o in outputs if o.title.lower() == x.parts[0].lower()]
                if found:
                    return found[0].value
            return lower.replace(x) if lower.replace else None

        return Lowering(lower.scope, titled, self.compat)(node)

    def finished(self, node: n.Select, taken: Callable[[], int], frame: DataFrame, outputs: list[Output], lower: Lowering) -> Plan:
        names = [f"o{k}" for k in range(len(outputs))]
        keys: list[tuple[str, n.Order]] = []
        hidden: dict[str, Column] = {}
        for order in node.order:
            key = self.order_key(order.value, outputs, lower)
            if key is None:
                continue
            if isinstance(key, Output):
                keys.append((names[next(k for k, o in enumerate(outputs) if o is key)], order))
            else:
                hidden[f"k{len(hidden)}"] = key.col
                keys.append((f"k{len(hidden) - 1}", order))
        # unlike titles may stand for one column, so outputs are positional until the end
        frame = frame.select(*[o.value.col.alias(x) for o, x in zip(outputs, names, strict=True)], *[c.alias(x) for x, c in hidden.items()])
        if node.distinct:
            if hidden:
                frame = frame.withColumn("__row", F.monotonically_increasing_id())
                frame = frame.groupBy(*names).agg(*[F.min_by(k, "__row").alias(k) for k in hidden])
            else:
                frame = frame.distinct()
        if keys:
            frame = frame.orderBy(*[self.direction(F.col(k), o) for k, o in keys])
        offset, limit = constant(node.offset), constant(node.limit)
        if offset:
            frame = frame.offset(offset)
        if limit is not None:
            frame = frame.limit(limit)
        titles = [o.title for o in outputs]
        return Plan(frame.select(*[F.col(x).alias(t) for x, t in zip(names, titles, strict=True)]), taken, titles, [o.value.kind for o in outputs])

    def direction(self, col: Column, order: n.Order) -> Column:
        first = order.ascending if order.nulls_first is None else order.nulls_first
        if order.ascending:
            return col.asc_nulls_first() if first else col.asc_nulls_last()
        return col.desc_nulls_first() if first else col.desc_nulls_last()
