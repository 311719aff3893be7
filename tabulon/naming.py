"""Names of databases, tables and columns made from paths and headers."""

from __future__ import annotations

from pathlib import PurePath


def sanitise(text: str) -> str:
    """Letters and digits of any script and `_`, in lower case; anything else is `_`, and no digit leads."""
    out = "".join(c if c.isalnum() or c == "_" else "_" for c in text).lower()
    return f"_{out}" if out[:1].isascii() and out[:1].isdigit() else out


def database_name(path: str) -> str:
    return sanitise(path.replace("\\", "/").removeprefix("./"))


def table_name(path: str) -> str:
    return sanitise(PurePath(path).stem)


def unique(name: str, taken) -> str:
    """The name, or with the first of _1, _2, ... that isn't taken."""
    if name not in taken:
        return name
    k = 1
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def column_names(headers: list[str | None]) -> list[str]:
    """Names of columns: empty headers are col1, col2, ... by place, repeats get _1, _2, ..."""
    out: list[str] = []
    for k, header in enumerate(headers, 1):
        out.append(unique(sanitise((header or "").strip()) or f"col{k}", out))
    return out
