"""XLS workbooks: BIFF8 records in an OLE2 compound file, read with the standard library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from tabulon.errors import LoadError
from tabulon.sources.sheets import DATE_FORMATS, from_serial, is_date_format

_MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_END = 0xFFFFFFFA  # sector numbers from here on are marks
# Record types.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FORMAT, XF, DATEMODE, FILEPASS = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x041E, 0x00E0, 0x0022, 0x002F
LABELSST, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, LABEL, RSTRING = 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207, 0x0204, 0x00D6


def sheets(path: str) -> Iterator[tuple[str, list[list[Any]]]]:
    """(name, rows of cells) of each worksheet, in the workbook's order."""
    try:
        with open(path, "rb") as f:
            book = Book(workbook_stream(f.read()))
        for name, offset in book.places:
            yield name, book.rows(offset)
    except (struct.error, IndexError, UnicodeDecodeError, ValueError) as error:
        raise LoadError(f"Cannot read `{path}`: {error}") from error


def workbook_stream(data: bytes) -> bytes:
    """The stream of records in a compound file."""
    if data[:8] != _MAGIC:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    directory, cutoff, small_start, difat, more = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<IIxxxxII", data, 56)
    size = 1 << shift
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    places = list(numbers(data[76:512]))
    for _ in range(more):
        if difat >= _END:
            break
        *part, difat = numbers(sector(difat))
        places += part
    table = [n for p in places if p < _END for n in numbers(sector(p))]

    def chain(at: int, links: list[int], limit: int) -> Iterator[int]:
        for _ in range(limit):
            if at >= _END or at >= len(links):
                return
            yield at
            at = links[at]

    join = lambda at: b"".join(sector(k) for k in chain(at, table, len(table)))
    entries, raw = {}, join(directory)
    for k in range(0, len(raw) - 127, 128):
        n = struct.unpack_from("<H", raw, k + 64)[0]
        name = raw[k : k + max(0, n - 2)].decode("utf-16-le")
        entries.setdefault((raw[k + 66], name), struct.unpack_from("<II", raw, k + 116))
    found = entries.get((2, "Workbook")) or entries.get((2, "Book"))
    if found is None:
        raise ValueError("no workbook inside")
    start, length = found
    if length >= cutoff:
        return join(start)[:length]
    root = next(v for (kind, _), v in entries.items() if kind == 5)
    pool, links = join(root[0]), [n for k in chain(small_start, table, len(table)) for n in numbers(sector(k))]
    small = 1 << small_shift
    return b"".join(pool[k * small : (k + 1) * small] for k in chain(start, links, len(links)))[:length]


def rk(value: int) -> int | float:
    """A packed number: 30 bits of an integer or of a double's top, perhaps hundredths."""
    if value & 2:
        number: int | float = struct.unpack("<i", struct.pack("<I", value))[0] >> 2
    else:
        number = struct.unpack("<d", struct.pack("<II", 0, value & 0xFFFFFFFC))[0]
    return number / 100 if value & 1 else number


class Strings:
    """Reads strings that run over a record's continuations, each of which may change the character width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def raw(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
            if len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, wide_length: bool = True) -> str:
        n = struct.unpack("<H", self.raw(2))[0] if wide_length else self.raw(1)[0]
        flags = self.raw(1)[0]
        runs = struct.unpack("<H", self.raw(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.raw(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at == len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
                wide = self.raw(1)[0] & 1
            step = min(n, (len(self.parts[self.part]) - self.at) // (2 if wide else 1))
            out += self.raw(step * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            n -= step
        self.raw(4 * runs + extra)
        return out


class Book:
    def __init__(self, data: bytes):
        self.data, self.places, self.strings, self.base_1904 = data, [], [], False
        formats: dict[int, bool] = {}
        styles: list[int] = []
        for kind, parts in self.records(0):
            body = parts[0]
            if kind == BOF and struct.unpack_from("<H", body)[0] != 0x0600:
                raise ValueError("only BIFF8 workbooks (Excel 97 and later) are supported")
            if kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == BOUNDSHEET and body[5] == 0:
                self.places.append((Strings([body[6:]]).text(wide_length=False), struct.unpack_from("<I", body)[0]))
            elif kind == SST:
                reader = Strings([body[8:], *parts[1:]])
                self.strings = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", body)[0]] = is_date_format(Strings([body[2:]]).text())
            elif kind == XF:
                styles.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == DATEMODE:
                self.base_1904 = body[0] == 1
        self.dates = {k for k, i in enumerate(styles) if formats.get(i, i in DATE_FORMATS)}

    def records(self, at: int) -> Iterator[tuple[int, list[bytes]]]:
        """Records up to the end mark, each with its continuations."""
        depth = 0
        while at + 4 <= len(self.data):
            kind, n = struct.unpack_from("<HH", self.data, at)
            parts, at = [self.data[at + 4 : at + 4 + n]], at + 4 + n
            while at + 4 <= len(self.data) and struct.unpack_from("<H", self.data, at)[0] == CONTINUE:
                n = struct.unpack_from("<H", self.data, at + 2)[0]
                parts.append(self.data[at + 4 : at + 4 + n])
                at += 4 + n
            depth += (kind == BOF) - (kind == EOF)
            if depth <= 1 or kind == EOF:
                yield kind, parts
            if depth == 0:
                return

    def number(self, value: int | float, style: int) -> Any:
        if style in self.dates:
            try:
                return from_serial(float(value), self.base_1904)
            except (OverflowError, ValueError):
                return float(value)
        return value

    def rows(self, offset: int) -> list[list[Any]]:
        cells: dict[tuple[int, int], Any] = {}
        waiting = None
        for kind, parts in self.records(offset):
            body = parts[0]
            if kind in (LABELSST, NUMBER, RK, BOOLERR, FORMULA, LABEL, RSTRING):
                row, column, style = struct.unpack_from("<HHH", body)
            if kind == LABELSST:
                cells[row, column] = self.strings[struct.unpack_from("<I", body, 6)[0]]
            elif kind == NUMBER:
                cells[row, column] = self.number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == RK:
                cells[row, column] = self.number(rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == MULRK:
                row, column = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    cells[row, column + k] = self.number(rk(value), style)
            elif kind == BOOLERR:
                cells[row, column] = None if body[7] else bool(body[6])
            elif kind in (LABEL, RSTRING):
                cells[row, column] = Strings([body[6:], *parts[1:]]).text()
            elif kind == FORMULA:
                if body[12:14] != b"\xff\xff":
                    cells[row, column] = self.number(struct.unpack_from("<d", body, 6)[0], style)
                elif body[6] == 1:
                    cells[row, column] = bool(body[8])
                elif body[6] == 0:
                    waiting = row, column
            elif kind == STRING and waiting:
                cells[waiting], waiting = Strings(parts).text(), None
        if not cells:
            return []
        width = max(c for _, c in cells) + 1
        return [[cells.get((r, c)) for c in range(width)] for r in range(max(r for r, _ in cells) + 1)]
