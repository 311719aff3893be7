"""XLSX and XLSM workbooks: zipped XML, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree as ET

from tabulon.errors import LoadError
from tabulon.sources.sheets import DATE_FORMATS, from_serial, is_date_format

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(path: str) -> Iterator[tuple[str, list[list[Any]]]]:
    """(name, rows of cells) of each worksheet, in the workbook's order."""
    try:
        with open(path, "rb") as f, zipfile.ZipFile(io.BytesIO(f.read())) as book:
            yield from Workbook(book).sheets()
    except (zipfile.BadZipFile, ET.ParseError, KeyError) as error:
        raise LoadError(f"Cannot read `{path}`: {error}") from error


def text_of(node: ET.Element) -> str:
    """The text of a string item, its runs joined; phonetic hints are left out."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, book: zipfile.ZipFile):
        self.book, self.names = book, set(book.namelist())
        self.strings = [text_of(si) for si in self.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.names else []
        self.dates = self.date_styles()
        self.root = self.xml("xl/workbook.xml")
        pr = self.root.find(f"{_MAIN}workbookPr")
        self.base_1904 = pr is not None and pr.get("date1904") in ("1", "true")

    def xml(self, name: str) -> ET.Element:
        return ET.fromstring(self.book.read(name))

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        if "xl/styles.xml" not in self.names:
            return set()
        root = self.xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): is_date_format(f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
        styles = root.find(f"{_MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
        return {k for k, i in enumerate(ids) if own.get(i, i in DATE_FORMATS)}

    def sheets(self) -> Iterator[tuple[str, list[list[Any]]]]:
        links = {r.get("Id"): r.get("Target") for r in self.xml("xl/_rels/workbook.xml.rels")}
        for sheet in self.root.find(f"{_MAIN}sheets"):
            target = links[sheet.get(_LINK)]
            name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if "worksheets" in name:
                yield sheet.get("name"), list(self.rows(name))

    def rows(self, name: str) -> Iterator[list[Any]]:
        with self.book.open(name) as f:
            for _, node in ET.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                cells: list[Any] = []
                for c in node.findall(f"{_MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self.value(c)
                yield cells
                node.clear()

    def value(self, c: ET.Element) -> Any:
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = c.find(f"{_MAIN}is")
            return text_of(inline) if inline is not None else None
        raw = v.text if v is not None else None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind in ("str", "d"):
            return raw
        if kind == "b":
            return raw.strip() in ("1", "true")
        number = float(raw)
        if int(c.get("s", 0)) in self.dates:
            try:
                return from_serial(number, self.base_1904)
            except (OverflowError, ValueError):
                return number
        return number


