"""The aggregate functions. NaN is left out of sums and averages; distinct values unify ints and floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import QueryError
from tabulon.functions.semantics import Typed

NAMES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX"})


def aggregate(name: str, arg: Typed | None, distinct: bool) -> Typed:
    """arg is None for COUNT(*)."""
    upper = name.upper()
    if arg is None:
        if upper != "COUNT":
            raise QueryError(f"{upper}(*) is not supported")
        return Typed(F.count(F.lit(1)), "int")
    if upper == "COUNT":
        return Typed(F.count_distinct(arg.col) if distinct else F.count(arg.col), "int")
    if upper in ("MIN", "MAX"):
        return Typed((F.min if upper == "MIN" else F.max)(arg.col), arg.kind)
    if arg.kind == "null":
        return Typed(F.max(F.lit(None).cast("double")), "float")
    if arg.kind not in ("int", "float"):
        raise QueryError(f"{upper} needs numbers, got {arg.kind}")
    value: Column = F.when(~F.isnan(arg.col), arg.col) if arg.kind == "float" else arg.col
    if upper == "SUM":
        return Typed(F.sum_distinct(value) if distinct else F.sum(value), arg.kind)
    return Typed(F.avg(value) if not distinct else F.sum_distinct(value.cast("double")) / F.count_distinct(value), "float")
