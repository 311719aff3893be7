"""Types of text cells. A column gets one Spark type from one pass over all its cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.semantics import Typed, display

KINDS = ("int", "float", "bool", "text")


def kind(cell: Column) -> Column:
    """int, float, bool or text; NULL for an empty cell. Numbers with leading zeros are text."""
    number = cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(cell.isNull() | (cell == ""), None)
        .when(cell.rlike(r"^-?0[0-9]+$"), "text")
        .when(cell.rlike(r"^[+-]?[0-9]+$"), F.when(cell.try_cast("bigint").isNotNull(), "int").otherwise("text"))
        .when(number & (F.abs(cell.try_cast("double")) < float("inf")), "float")
        .when(F.lower(cell).isin("true", "false"), "bool")
        .otherwise("text")
    )


def seen(cell: Column) -> Column:
    """Aggregate: which kinds the cells have, as a number of bits in the order of KINDS."""
    k = kind(cell)
    bits = F.lit(0)
    for n, name in enumerate(KINDS):
        bits = bits + F.coalesce(F.max(F.when(k == name, 1)), F.lit(0)) * F.lit(1 << n)
    return bits


def settled(bits: int) -> tuple[str, str]:
    """(kind of the column, label for DESCRIBE) from the kinds seen."""
    kinds = {name for n, name in enumerate(KINDS) if bits >> n & 1}
    label = next((lab for name, lab in (("text", "Text"), ("bool", "Boolean"), ("float", "Float"), ("int", "Integer")) if name in kinds), "Text")
    if kinds == {"int"}:
        return "int", label
    if kinds and kinds <= {"int", "float"}:
        return "float", label
    return ("bool" if kinds == {"bool"} else "text"), label


def typed(cell: Column, to: str, mixed: bool = False) -> Column:
    """The cell as the column's kind; in a mixed text column as the display text of its own kind."""
    cell = F.when(cell != "", cell)
    if to == "int":
        return cell.try_cast("bigint")
    if to == "float":
        return cell.try_cast("double")
    if to == "bool":
        return F.lower(cell) == "true"
    if not mixed:
        return cell
    k = kind(cell)
    return F.when(k == "int", cell.try_cast("bigint").cast("string")).when(k == "float", display(Typed(cell.try_cast("double"), "float"))).when(k == "bool", F.lower(cell)).otherwise(cell)
