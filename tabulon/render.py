"""Results as text: a drawn table, JSON, CSV and YAML, and CSV files."""

from __future__ import annotations

import csv
import datetime
import io
import json
import math
import os
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

FORMATS = {"json": "json", "csv": "csv", "yaml": "yaml", "render": "table", "table": "table"}


def shown(value: Any) -> str:
    """A cell's text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return shown_float(value)
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def shown_float(x: float) -> str:
    """Whole numbers without a fraction, others in full digits without an exponent."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e15:
        return f"{x:.0f}"
    text = repr(x)
    if "e" not in text:
        return text.removesuffix(".0")
    digits, power = text.split("e")
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    head, _, tail = digits.partition(".")
    point = len(head) + int(power)
    digits = (head + tail).rstrip("0") or "0"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")


def plain(value: Any) -> Any:
    """A cell as a value of JSON: numbers stay numbers, but none that JSON lacks."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return shown(value)


def keys(columns: list[str]) -> list[str]:
    """Titles with repeats as a_2, a_3, ..."""
    out: list[str] = []
    for c in columns:
        k, name = 1, c
        while name in out:
            k += 1
            name = f"{c}_{k}"
        out.append(name)
    return out


def objects(columns: list[str], rows: Iterable[tuple]) -> list[dict[str, Any]]:
    names = keys(columns)
    return [dict(sorted(zip(names, map(plain, r), strict=True))) for r in rows]


def csv_lines(columns: list[str], rows: Iterable[tuple]) -> Iterator[str]:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for row in [columns]:
        writer.writerow(row)
    for row in rows:
        writer.writerow([shown(v) for v in row])
        if out.tell() > 1 << 20:
            yield out.getvalue()
            out.seek(0)
            out.truncate()
    yield out.getvalue()


def yaml_text(rows: list[dict[str, Any]]) -> str:
    """Block lists of flat maps, texts quoted where YAML would read them otherwise (a JSON string is YAML)."""
    if not rows:
        return "[]\n"
    import re

    safe = re.compile(r"[^\W\d][\w ./()*+-]*\w\)?|[^\W\d]\w*")
    words = {"true", "false", "null", "yes", "no", "on", "off", "y", "n", "nan", "inf"}

    def scalar(v: Any) -> str:
        if isinstance(v, str):
            return v if safe.fullmatch(v) and v.lower() not in words else json.dumps(v, ensure_ascii=False)
        return json.dumps(v)

    return "".join(("- " if k == 0 else "  ") + f"{scalar(name)}: {scalar(value)}\n" for row in rows for k, (name, value) in enumerate(row.items()))


def width(text: str) -> int:
    """Terminal cells: wide characters take two, combining marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_text(columns: list[str], rows: Iterable[tuple]) -> str:
    if not columns:
        return ""
    lines = [columns, *[[shown(v) for v in r] for r in rows]]
    sizes = [max(width(line[k]) for line in lines) + 2 for k in range(len(columns))]

    def row(cells: list[str]) -> str:
        out = []
        for text, size in zip(cells, sizes, strict=True):
            room = size - width(text)
            out.append(" " * (room // 2) + text + " " * (room - room // 2))
        return "│" + "│".join(out) + "│\n"

    def rule(left: str, fill: str, cross: str, right: str) -> str:
        return left + cross.join(fill * s for s in sizes) + right + "\n"

    body = rule("├", "─", "┼", "┤").join(row(line) for line in lines[1:])
    return rule("╭", "─", "┬", "╮") + row(columns) + rule("╞", "═", "╪", "╡") + body + rule("╰", "─", "┴", "╯")


def render(form: str, columns: list[str], rows: Iterable[tuple]) -> str:
    if form == "json":
        return json.dumps(objects(columns, rows), indent=2, ensure_ascii=False) + "\n"
    if form == "yaml":
        return yaml_text(objects(columns, rows))
    if form == "csv":
        return "".join(csv_lines(columns, rows))
    return table_text(columns, rows)


def write_csv(path: str | os.PathLike, columns: list[str], rows: Iterable[tuple], overwrite: bool = False) -> int:
    """Streams rows into one file on the driver; returns their number. Without overwrite the file must be new."""
    n = 0

    def counted() -> Iterator[tuple]:
        nonlocal n
        for r in rows:
            n += 1
            yield r

    with Path(path).open("w" if overwrite else "x", encoding="utf-8", newline="") as f:
        for text in csv_lines(columns, counted()):
            f.write(text)
    return n
