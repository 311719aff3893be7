"""Typed values and the rules between types: truth, display text, comparison, membership, patterns.

Every expression lowers to a Typed: a Catalyst column and its kind. All differences from Spark's own
rules are settled here from the kinds, at analysis time, so only built-in expressions reach the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import QueryError

#: Kinds in the order in which values of different kinds sort.
RANK = {"null": 0, "bool": 1, "int": 2, "float": 3, "text": 4, "date": 5, "datetime": 6}
SPARK_TYPE = {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "text": "string", "date": "date", "datetime": "timestamp_ntz"}
NUMBERS = ("int", "float")
TIMES = ("date", "datetime")


@dataclass(frozen=True)
class Typed:
    col: Column
    kind: str
    #: The value itself where it is a literal, which lets plans push it into scans.
    literal: Any = None
    is_literal: bool = False


def kind_of(dtype: T.DataType) -> str:
    """The engine's kind of a Spark type; what has none is shown as text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "null" if isinstance(dtype, T.NullType) else "text"


def column(col: Column, dtype: T.DataType) -> Typed:
    """A stored column as one of the engine's types."""
    kind = kind_of(dtype)
    plain = {"int": T.LongType, "float": T.DoubleType, "datetime": T.TimestampNTZType, "text": T.StringType, "null": T.StringType}.get(kind)
    if plain is None or isinstance(dtype, plain):
        return Typed(col, kind)
    if kind == "text":
        col = F.to_json(col) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else F.decode(col, "UTF-8") if isinstance(dtype, T.BinaryType) else col
    return Typed(col.cast(SPARK_TYPE[kind]), kind)


def literal(value: Any, kind: str) -> Typed:
    return Typed(F.lit(value).cast(SPARK_TYPE[kind]), kind, value, True)


def null(kind: str = "null") -> Typed:
    return Typed(F.lit(None).cast(SPARK_TYPE[kind]), kind, None, True)


def truthy(x: Typed) -> Column:
    """Boolean itself, a number unless 0, a text unless empty, a date always; NULL stays NULL."""
    if x.kind == "bool":
        return x.col
    if x.kind in NUMBERS:
        return x.col != 0
    if x.kind == "text":
        return x.col != ""
    return F.lit(None).cast("boolean") if x.kind == "null" else F.when(x.col.isNotNull(), True)


def display(x: Typed) -> Column:
    """The text of a value: whole floats without a fraction, no exponents where decimals hold them."""
    if x.kind in ("text", "null"):
        return x.col
    if x.kind != "float":
        return x.col.cast("string")
    size = F.abs(x.col)
    whole = (x.col == F.floor(x.col)) & (size < 1e15)
    exact = F.regexp_replace(x.col.cast("decimal(38,18)").cast("string"), "\\.?0+$", "")
    return F.when(F.isnan(x.col) | (size == float("inf")), x.col.cast("string")).when(whole, x.col.cast("bigint").cast("string")).when((size >= 1e-6) & (size < 1e18), exact).otherwise(x.col.cast("string"))


_DATE = re.compile(r"\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(\.\d+)?)?)?\s*")


def as_time(x: Typed) -> Column:
    """A text as timestamp_ntz, NULL where it isn't a date or date with time; a literal folds here."""
    if x.is_literal:
        m = _DATE.fullmatch(x.literal)
        if not m:
            return F.lit(None).cast("timestamp_ntz")
        y, mo, d, h, mi, s, f = m.groups()
        return F.lit(f"{y}-{int(mo):02}-{int(d):02} {int(h or 0):02}:{int(mi or 0):02}:{int(s or 0):02}{f or ''}").try_cast("timestamp_ntz")
    plain = F.regexp_replace(x.col, r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?=$|[ T])", "$1-$2-$3")
    return F.when(plain.rlike(r"^\d{4}-"), plain).try_cast("timestamp_ntz")


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Three-valued comparison; values of kinds that don't mix are unequal and sort by kind."""
    f = _OPERATORS[op]
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if a.kind == b.kind or (a.kind in NUMBERS and b.kind in NUMBERS):
        return f(a.col, b.col)
    if a.kind in TIMES and b.kind in TIMES:
        return f(a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz"))
    by_rank = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(f(RANK[a.kind], RANK[b.kind])))
    for text, time in ((a, b), (b, a)):
        if text.kind == "text" and time.kind in TIMES:
            parsed = as_time(text)
            if text.is_literal:
                if not _DATE.fullmatch(text.literal):
                    return by_rank
                # a date column stays bare, so the comparison can be pushed into the scan
                day = time.kind == "date" and not _DATE.fullmatch(text.literal)[4]
                left, right = (parsed.cast("date"), time.col) if day else (parsed, time.col.cast("timestamp_ntz"))
                return f(left, right) if text is a else f(right, left)
            other = time.col.cast("timestamp_ntz")
            return F.when(parsed.isNotNull(), f(parsed, other) if text is a else f(other, parsed)).otherwise(by_rank)
    return by_rank


def member(x: Typed, items: list[Typed]) -> Column:
    """IN: true on a match, else NULL if x or an item is NULL."""
    if not items:
        return F.when(x.col.isNotNull(), False)
    plain = [i for i in items if i.is_literal and i.literal is not None]
    alike = all(i.kind == x.kind or (i.kind in NUMBERS and x.kind in NUMBERS) for i in plain)
    if len(plain) == len(items) and alike and x.kind not in TIMES:
        return x.col.isin([i.literal for i in plain])
    return reduce(lambda p, q: p | q, [compare("=", x, i) for i in items])


def between(x: Typed, low: Typed, high: Typed) -> Column:
    """Never NULL: bounds and value are ordered with NULL as the smallest."""
    return F.coalesce(compare(">=", x, low), low.col.isNull()) & F.coalesce(compare("<=", x, high), x.col.isNull())


def pattern_parts(pattern: str, escape: str | None) -> list[str | None]:
    """Literal characters, with None for % and '' for _; a trailing escape is ignored."""
    out: list[str | None] = []
    chars = iter(pattern)
    for c in chars:
        if escape is not None and c == escape:
            c = next(chars, None)
            if c is not None:
                out.append(c)
        else:
            out.append(None if c == "%" else "" if c == "_" else c)
    return out


def pattern_regex(pattern: str, escape: str | None = None) -> str:
    body = "".join(".*" if p is None else "." if p == "" else re.sub(r"([^\w\s])", r"\\\1", p) for p in pattern_parts(pattern, escape))
    return f"(?s)^{body}\\z"


def like(x: Typed, pattern: Typed, escape: str | None, fold: bool, substring: bool = False) -> Column:
    """LIKE over display texts; a pattern of one literal between wildcards becomes a plain string test."""
    text = display(x)
    if "null" in (x.kind, pattern.kind):
        return F.lit(None).cast("boolean")
    if fold:
        text = F.lower(text)
    if not pattern.is_literal:
        wanted = display(pattern)
        wanted = F.lower(wanted) if fold else wanted
        if escape is None:
            plain = F.like(text, F.replace(wanted, F.lit("\\"), F.lit("\\\\")))
        else:
            plain = F.like(text, wanted, F.lit(escape))
        return F.when(~wanted.rlike("[%_]") & (wanted != ""), F.contains(text, wanted)).otherwise(plain) if substring else plain
    wanted = str(pattern.literal)
    parts = pattern_parts(wanted.lower() if fold else wanted, escape)
    inner = [p for p in parts if p]
    word = "".join(inner)
    if "" not in parts:
        stars = [k for k, p in enumerate(parts) if p is None]
        if not stars:
            return F.contains(text, F.lit(word)) if substring and word else text == word
        core = parts[:]
        opens, closes = core[0] is None, core[-1] is None
        while core and core[0] is None:
            core.pop(0)
        while core and core[-1] is None:
            core.pop()
        if None not in core:
            if not core:
                return F.when(text.isNotNull(), True)
            return text.contains(word) if opens and closes else text.endswith(word) if opens else text.startswith(word)
    return text.rlike(pattern_regex(wanted.lower() if fold else wanted, escape))


def common_kind(values: list[Typed]) -> str:
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) <= 1:
        return next(iter(kinds), "null")
    if kinds <= set(NUMBERS):
        return "float"
    return "datetime" if kinds <= set(TIMES) else "text"


def unified(values: list[Typed]) -> tuple[list[Column], str]:
    """The values as one type: numbers meet as floats, unlike kinds as display text."""
    kind = common_kind(values)
    return [v.col if v.kind == kind else display(v) if kind == "text" and v.kind != "null" else v.col.cast(SPARK_TYPE[kind]) for v in values], kind


def number(x: Typed, what: str) -> Column:
    if x.kind not in (*NUMBERS, "null"):
        raise QueryError(f"{what} needs a number, got {x.kind}")
    return x.col.cast("double") if x.kind == "null" else x.col


def whole(x: Typed, what: str) -> Column:
    return number(x, what).cast("bigint")
