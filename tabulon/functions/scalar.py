"""The scalar functions: name -> (fewest, most arguments, lowering). All are built-in compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import QueryError
from tabulon.functions.semantics import NUMBERS, Typed, display, null, number, unified, whole

MANY = 1 << 30
#: White space of Unicode, as a class for regular expressions.
_WHITE = r"[\s\u0085   -     　]"


def text(col: Column) -> Typed:
    return Typed(col, "text")


def integer(col: Column) -> Typed:
    return Typed(col.cast("bigint"), "int")


def real(col: Column) -> Typed:
    return Typed(col, "float")


def trim(args: list[Typed], left: bool, right: bool) -> Typed:
    """One argument: white space; two: any of the second's characters."""
    shown = display(args[0])
    if len(args) == 2:
        chars = display(args[1])
        f = F.btrim if left and right else None
        if f:
            return text(f(shown, chars))
        return text(F.ltrim(shown, chars) if left else F.rtrim(shown, chars))
    edges = ([f"^{_WHITE}+"] if left else []) + ([f"{_WHITE}+\\z"] if right else [])
    return text(F.regexp_replace(shown, "|".join(edges), ""))


def place(x: Column) -> Column:
    """A whole number as Spark's int: one beyond it reaches past any text all the same."""
    most = 2**31 - 1
    return F.when(x > most, most).when(x < -most, -most).otherwise(x).cast("int")


def substring(args: list[Typed]) -> Typed:
    """From character 1; start 0 gives '', a negative start counts as 1, a negative length as 0."""
    shown, start = display(args[0]), place(whole(args[1], "SUBSTRING"))
    size = place(F.greatest(whole(args[2], "SUBSTRING"), F.lit(0))) if len(args) == 3 else F.length(shown)
    found = F.when(start >= 1, F.substring(shown, start, size)).when(start == 0, "").otherwise(F.substring(shown, F.lit(1), size))
    return text(F.when(start.isNotNull() & size.isNotNull(), found))


def split(args: list[Typed]) -> Typed:
    """The n-th part between literal separators; NULL beyond the last or below 1."""
    shown, mark, n = display(args[0]), display(args[1]), place(whole(args[2], "SPLIT"))
    quoted = F.concat(F.lit("\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.when(mark == "", F.array(shown)).otherwise(F.split(shown, quoted, F.lit(-1)))
    return text(F.when(n >= 1, F.try_element_at(parts, n)))


def round_(args: list[Typed]) -> Typed:
    """Half away from zero, of the double scaled by a power of ten."""
    x = number(args[0], "ROUND").cast("double")
    if len(args) == 1:
        return real(F.round(x))
    digits = args[1]
    scale = F.lit(10.0**digits.literal) if digits.is_literal and isinstance(digits.literal, int) else F.pow(F.lit(10.0), whole(digits, "ROUND").cast("double"))
    return real(F.round(x * scale) / scale)


def date(args: list[Typed]) -> Typed:
    """The date part; a text that holds no date is returned as it is."""
    if not args:
        return Typed(F.current_date(), "date")
    x = args[0]
    if x.kind in ("date", "datetime"):
        return Typed(x.col.cast("date"), "date")
    shown = display(x)
    form = r"^(\d{4})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])(?:[\sT].*)?$"
    part = lambda k: F.regexp_extract(shown, form, k)
    return text(F.when(shown.rlike(form), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise(shown))


def sqrt(args: list[Typed]) -> Typed:
    x = number(args[0], "SQRT").cast("double")
    return real(F.when(x < 0, F.raise_error(F.lit("SQRT of a negative number")).cast("double")).otherwise(F.sqrt(x)))


def extreme(f: Callable, args: list[Typed]) -> Typed:
    columns, kind = unified(args)
    if any(a.kind == "null" for a in args):
        return null(kind)
    if len(columns) == 1:
        return Typed(columns[0], kind)
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing | c.isNull()
    return Typed(F.when(~missing, f(*columns)), kind)


def first_of(args: list[Typed]) -> Typed:
    columns, kind = unified(args)
    return Typed(F.coalesce(*columns), kind)


def absolute(args: list[Typed]) -> Typed:
    x = number(args[0], "ABS")
    return Typed(F.abs(x), args[0].kind if args[0].kind in NUMBERS else "float")


def affix(f: Callable) -> Callable[[list[Typed]], Typed]:
    return lambda a: Typed(f(display(a[0]), display(a[1])), "bool")


def replaced(args: list[Typed]) -> Typed:
    return text(F.replace(*[display(a) for a in args]))


def side(f: Callable, name: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: text(f(display(a[0]), place(whole(a[1], name))))


def rounding(f: Callable, name: str) -> Callable[[list[Typed]], Typed]:
    """Doubles of 2^52 and more are whole already, and too large for f's bigint."""

    def rounded(args: list[Typed]) -> Typed:
        x = number(args[0], name).cast("double")
        return real(F.when(F.abs(x) < 2.0**52, f(x).cast("double")).otherwise(x))

    return rounded


Lowering = Callable[[list[Typed]], Typed]
FUNCTIONS: dict[str, tuple[int, int, Lowering]] = {
    "LEN": (1, 1, lambda a: integer(F.length(display(a[0])))),
    "LOWER": (1, 1, lambda a: text(F.lower(display(a[0])))),
    "UPPER": (1, 1, lambda a: text(F.upper(display(a[0])))),
    "TRIM": (1, 1, lambda a: trim(a, True, True)),
    "TRIM BOTH": (1, 2, lambda a: trim(a, True, True)),
    "TRIM LEADING": (1, 2, lambda a: trim(a, True, False)),
    "TRIM TRAILING": (1, 2, lambda a: trim(a, False, True)),
    "LTRIM": (1, 1, lambda a: trim(a, True, False)),
    "RTRIM": (1, 1, lambda a: trim(a, False, True)),
    "CONCAT": (1, MANY, lambda a: text(F.concat(*[display(x) for x in a]))),
    "SUBSTRING": (2, 3, substring),
    "REPLACE": (3, 3, replaced),
    "LEFT": (2, 2, side(F.left, "LEFT")),
    "RIGHT": (2, 2, side(F.right, "RIGHT")),
    "INSTR": (2, 2, lambda a: integer(F.instr(display(a[0]), display(a[1])))),
    "STARTSWITH": (2, 2, affix(F.startswith)),
    "ENDSWITH": (2, 2, affix(F.endswith)),
    "SPLIT": (3, 3, split),
    "ABS": (1, 1, absolute),
    "ROUND": (1, 2, round_),
    "FLOOR": (1, 1, rounding(F.floor, "FLOOR")),
    "CEIL": (1, 1, rounding(F.ceil, "CEIL")),
    "MOD": (2, 2, lambda a: integer(whole(a[0], "MOD") % whole(a[1], "MOD"))),
    "POWER": (2, 2, lambda a: real(F.pow(number(a[0], "POWER").cast("double"), number(a[1], "POWER").cast("double")))),
    "SQRT": (1, 1, sqrt),
    "GREATEST": (1, MANY, lambda a: extreme(F.greatest, a)),
    "LEAST": (1, MANY, lambda a: extreme(F.least, a)),
    "NOW": (0, 0, lambda a: Typed(F.date_trunc("second", F.localtimestamp().cast("timestamp")).cast("timestamp_ntz"), "datetime")),
    "DATE": (0, 1, date),
    "IFNULL": (2, 2, first_of),
    "COALESCE": (1, MANY, first_of),
}
ALIASES = {"LENGTH": "LEN", "CHAR_LENGTH": "LEN", "LCASE": "LOWER", "UCASE": "UPPER", "SUBSTR": "SUBSTRING", "CEILING": "CEIL", "POW": "POWER", "CURRENT_TIMESTAMP": "NOW", "ISNULL": "IFNULL"}


def call(name: str, args: list[Typed]) -> Typed:
    upper = name.upper()
    found = FUNCTIONS.get(ALIASES.get(upper, upper))
    if found is None:
        raise QueryError(f"Unknown function {name}")
    low, high, lowering = found
    if not low <= len(args) <= high:
        wanted = f"{low}" if low == high else f"at least {low}" if high == MANY else f"{low} to {high}"
        raise QueryError(f"{upper} takes {wanted} argument(s), got {len(args)}")
    return lowering(args)
