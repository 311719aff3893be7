"""From expressions to typed Catalyst columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import QueryError, UnsupportedError
from tabulon.functions import aggregates, scalar
from tabulon.functions.semantics import NUMBERS, Typed, between, compare, display, like, literal, member, null, number, truthy, unified, whole
from tabulon.plans.scope import Scope
from tabulon.sql import nodes as n


def is_aggregate(node: n.Node) -> bool:
    return isinstance(node, n.Call) and node.name.upper() in aggregates.NAMES


def has_aggregate(node: n.Node) -> bool:
    return any(is_aggregate(x) for x in node.walk())


def is_constant(node: n.Node) -> bool:
    """Without any column or aggregate: such keys neither sort nor group."""
    return not any(isinstance(x, n.Name) or is_aggregate(x) for x in node.walk())


class Lowering:
    """Lowers expressions over a scope; `replace` may answer for a node first (keys and aggregates of a group)."""

    def __init__(self, scope: Scope, replace: Callable[[n.Node], Typed | None] | None = None, compat: bool = False):
        self.scope, self.replace, self.compat = scope, replace, compat

    def condition(self, node: n.Node) -> Column:
        """A filter's condition. Here NULL is as good as false, so conjuncts stay in forms that scans take."""
        if isinstance(node, n.Nested):
            return self.condition(node.value)
        if isinstance(node, n.Binary) and node.op == "AND":
            return self.condition(node.left) & self.condition(node.right)
        if isinstance(node, n.Between) and not node.negated:
            value, low, high = self(node.value), self(node.low), self(node.high)
            if all(b.is_literal and b.literal is not None for b in (low, high)):
                return compare(">=", value, low) & compare("<=", value, high)
        return truthy(self(node))

    def __call__(self, node: n.Node) -> Typed:
        if self.replace and (found := self.replace(node)) is not None:
            return found
        return getattr(self, type(node).__name__.lower())(node)

    def literal(self, node: n.Literal) -> Typed:
        return null() if node.kind == "null" else literal(node.value, node.kind)

    def name(self, node: n.Name) -> Typed:
        return self.scope.of(node).typed()

    def star(self, node: n.Star) -> Typed:
        raise QueryError(f"{node} is not a value")

    def nested(self, node: n.Nested) -> Typed:
        return self(node.value)

    def unary(self, node: n.Unary) -> Typed:
        x = self(node.value)
        if node.op == "NOT":
            return Typed(~truthy(x), "bool")
        value = number(x, f"Unary {node.op}")
        if node.op == "+":
            return x
        if x.is_literal and x.kind in NUMBERS:
            return literal(-x.literal, x.kind)
        return Typed(-value, x.kind if x.kind in NUMBERS else "float")

    def binary(self, node: n.Binary) -> Typed:
        a, b, op = self(node.left), self(node.right), node.op
        if op == "AND":
            return Typed(truthy(a) & truthy(b), "bool")
        if op == "OR":
            return Typed(truthy(a) | truthy(b), "bool")
        if op == "||":
            return Typed(F.concat(display(a), display(b)), "text")
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return Typed(compare(op, a, b), "bool")
        x, y = number(a, op), number(b, op)
        if op == "/":
            return Typed(x.cast("double") / y.cast("double"), "float")
        if op == "%":
            return Typed(whole(a, op) % whole(b, op), "int")
        if a.kind != "int" or b.kind != "int":
            x, y = x.cast("double"), y.cast("double")
        out = x + y if op == "+" else x - y if op == "-" else x * y
        return Typed(out, "int" if a.kind == b.kind == "int" else "float")

    def is_(self, node: n.Is) -> Typed:
        x = self(node.value)
        if node.what == "NULL":
            return Typed(x.col.isNotNull() if node.negated else x.col.isNull(), "bool")
        true = truthy(x)
        if self.compat and node.what == "FALSE":
            hit = ~F.coalesce(true, F.lit(False))
        else:
            hit = F.coalesce(true if node.what == "TRUE" else ~true, F.lit(False))
        return Typed(~hit if node.negated else hit, "bool")

    def in_(self, node: n.In) -> Typed:
        hit = member(self(node.value), [self(i) for i in node.items])
        return Typed(~hit if node.negated else hit, "bool")

    def between(self, node: n.Between) -> Typed:
        hit = between(self(node.value), self(node.low), self(node.high))
        return Typed(~hit if node.negated else hit, "bool")

    def like(self, node: n.Like) -> Typed:
        hit = like(self(node.value), self(node.pattern), node.escape, node.fold, substring=self.compat)
        return Typed(~hit if node.negated else hit, "bool")

    def case(self, node: n.Case) -> Typed:
        results = [self(r) for _, r in node.branches] + [self(node.otherwise) if node.otherwise else null()]
        columns, kind = unified(results)
        if node.operand is None:
            tests = [truthy(self(c)) for c, _ in node.branches]
        else:
            operand = self(node.operand)
            tests = [self.meets(operand, self(c)) for c, _ in node.branches]
        out = F.when(tests[0], columns[0])
        for test, value in zip(tests[1:], columns[1:-1], strict=True):
            out = out.when(test, value)
        return Typed(out.otherwise(columns[-1]), kind)

    def meets(self, operand: Typed, value: Typed):
        """Whether CASE takes a branch; in the compatible mode NULL meets NULL."""
        same = compare("=", operand, value)
        return F.coalesce(same, F.lit(False)) | (operand.col.isNull() & value.col.isNull()) if self.compat else same

    def cast(self, node: n.Cast) -> Typed:
        x = self(node.value)
        if node.type == "text":
            return Typed(display(x), "text")
        if x.kind == "null":
            return null(node.type)
        refuse = QueryError(f"Cannot cast {x.kind} to {node.shown}")
        fail = lambda: F.raise_error(F.concat(F.lit("Cannot cast '"), display(x), F.lit(f"' to {node.shown}")))
        if node.type == "bool":
            if x.kind == "bool":
                return x
            if x.kind != "text":
                raise refuse
            low = F.lower(x.col)
            return Typed(F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(x.col.isNotNull(), fail().cast("boolean")), "bool")
        if x.kind in NUMBERS:
            return Typed(x.col.cast("bigint" if node.type == "int" else "double"), node.type)
        if x.kind != "text":
            raise refuse
        form = r"^[+-]?\d+$" if node.type == "int" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
        to = "bigint" if node.type == "int" else "double"
        return Typed(F.when(x.col.rlike(form), x.col.cast(to)).when(x.col.isNotNull(), fail().cast(to)), node.type)

    def call(self, node: n.Call) -> Typed:
        if is_aggregate(node):
            raise QueryError(f"{node} is not allowed here")
        if node.distinct:
            raise UnsupportedError(f"DISTINCT in {node.name} is not supported")
        return scalar.call(node.name, [self(a) for a in node.args])


for _name in ("is", "in"):
    setattr(Lowering, _name, getattr(Lowering, f"{_name}_"))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
