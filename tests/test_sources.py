"""Files as tables: CSV, XLSX and XLS, their types, names and limits."""

from __future__ import annotations

import datetime
import struct
import zipfile

import pytest

from tabulon.errors import LoadError
from tabulon.naming import column_names, database_name, sanitise, table_name, unique
from tabulon.session import Engine
from tabulon.sources.csv import records


def load(spark, tmp_path, text, name="data.csv", **options):
    path = tmp_path / name
    path.write_text(text)
    return Engine(spark).load(str(path), **options)


def result(engine, sql):
    return engine.run(sql, stats=False).rows


def test_names():
    assert sanitise("Na-me 1") == "na_me_1"
    assert sanitise("2024") == "_2024"
    assert sanitise("销售 表") == "销售_表"
    assert database_name("data/Sales.csv") == "data_sales_csv"
    assert table_name("a/b/My Data.csv") == "my_data"
    assert column_names(["Name", "", "Name", "Na-me", None]) == ["name", "col2", "name_1", "na_me", "col5"]
    assert unique("t", {"t": 1, "t_1": 1}) == "t_2"


def test_csv_types(spark, tmp_path):
    e = load(spark, tmp_path, 'i,f,b,t,m,n\n1,1.5,true,007,1,\n-2,3,FALSE,"a,b",x,\n,,,,,\n3,,,"c\nd",2.50\n')
    assert result(e, "SELECT * FROM data") == [(1, 1.5, True, "007", "1", None), (-2, 3.0, False, "a,b", "x", None), (3, None, None, "c\nd", "2.5", None)]
    assert [t for _, t in result(e, "DESCRIBE data")] == ["Integer", "Float", "Boolean", "Text", "Text", "Text"]
    assert e.catalog.current.endswith("data_csv")


def test_csv_cells(spark, tmp_path):
    cells = ["42", "-7", "2.5", "true", "FALSE", "Alice", "0012", "-007", "a1b2", "9" * 30, "NaN", "inf", " 42", "+5", "1e400", ".5", "5.", "1e3", "-0", "00.5", "1d", "0x10"]
    from tabulon.sources.infer import kind

    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    kinds = [r[0] for r in frame.select(kind(frame.c)).collect()]
    assert kinds == ["int", "int", "float", "bool", "bool", "text", "text", "text", "text", "text", "text", "text", "text", "int", "text", "float", "float", "float", "int", "float", "text", "text"]


def test_csv_options(spark, tmp_path):
    e = load(spark, tmp_path, "1;NA\n2;ok\n", delimiter=";", header=False, null_value="NA")
    assert result(e, "SELECT col1, col2 FROM data ORDER BY col1") == [(1, None), (2, "ok")]


def test_csv_limits(spark, tmp_path):
    with pytest.raises(LoadError, match="line 3"):
        load(spark, tmp_path, 'a,b\n1,"x,y"\n1,2,3\n')
    with pytest.raises(LoadError):
        load(spark, tmp_path, "a,b\n1,2,\n")
    with pytest.raises(LoadError, match="more than 1 rows"):
        load(spark, tmp_path, "a\n1\n2\n", max_rows=1)
    assert result(load(spark, tmp_path, "a\n1\n2\n", max_rows=2), "SELECT COUNT(*) FROM data") == [(2,)]
    with pytest.raises(LoadError, match="bytes"):
        load(spark, tmp_path, "a\n1\n", max_bytes=3)


def test_csv_short_empty_and_header_only(spark, tmp_path):
    assert result(load(spark, tmp_path, "a,b\n1\n"), "SELECT * FROM data") == [(1, None)]
    assert result(load(spark, tmp_path, "a,b\n"), "SELECT * FROM data") == []
    assert result(load(spark, tmp_path, ""), "SHOW TABLES") == []


def test_paths(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x\n1\n")
    e = Engine(spark).load([str(tmp_path / "*.csv"), str(tmp_path / "a.csv")])
    assert len(e.catalog.databases) == 2
    assert e.catalog.current is None
    for bad in ("none*.csv", "missing.csv", "a.txt"):
        with pytest.raises(LoadError):
            Engine(spark).load(str(tmp_path / bad))


def xlsx(path, sheets, strings=(), styles=(0, 14, 22, 164), formats={164: "yyyy\\-mm\\-dd hh:mm"}):
    """A small workbook: sheets of {reference: cell XML}."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}><numFmts>" + "".join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in formats.items()) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{i}"/>' for i in styles) + "</cellXfs></styleSheet>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    head = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>When</t></is></c><c r="C1" t="str"><v>At</v></c><c r="E1" t="s"><v>1</v></c>'
    rows = [
        head,
        '<c r="A2"><v>1</v></c><c r="B2" s="1"><v>46149</v></c><c r="C2" s="3"><v>46149.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="F2"><v>9</v></c>',
        '<c r="D3"/>',
        '<c r="A4"><v>2.5</v></c><c r="C4" s="2"><v>46149</v></c><c r="E4" t="s"><v>1</v></c>',
    ]
    xlsx(path, {"My Sheet": rows, "Empty": []}, ["<t>Id</t>", "<r><t>rich </t></r><r><t>text</t></r>"])
    e = Engine(spark).load(str(path))
    assert result(e, "SHOW TABLES") == [("my_sheet",)]
    day = datetime.date(2026, 5, 7)
    assert e.sql("SELECT * FROM my_sheet").columns == ["id", "when", "at", "col4", "rich_text"]
    assert result(e, "SELECT * FROM my_sheet") == [(1.0, day, datetime.datetime(2026, 5, 7, 12), True, None), (2.5, None, datetime.datetime(2026, 5, 7), None, "rich text")]
    assert result(e, "SELECT id FROM my_sheet WHERE `when` = '2026/5/7'") == [(1.0,)]
    with pytest.raises(LoadError):
        Engine(spark).load(str(path), max_rows=1)
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(LoadError):
        Engine(spark).load(str(tmp_path / "bad.xlsx"))


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def compound(stream):
    """A compound file of one stream, in sectors of 512 bytes."""
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, size, 0)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream)) + b"\0" * 256
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0) + b"\xff" * (4 * 108)
    return head + struct.pack("<128I", *fat) + directory + stream


def test_xls(spark, tmp_path):
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    wide = struct.pack("<HB", 4, 1) + "商品".encode("utf-16-le")
    shared = [record(0x00FC, struct.pack("<II", 3, 3) + text("Id") + text("Day") + wide), record(0x003C, b"\0ab")]
    globals_ = record(0x0809, struct.pack("<HH", 0x0600, 5) + b"\0" * 12) + record(0x00E0, struct.pack("<HH", 0, 0) + b"\0" * 16) + record(0x00E0, struct.pack("<HH", 0, 14) + b"\0" * 16) + b"".join(shared)
    name = b"\x04\0Data"
    at = len(globals_) + 4 + 6 + len(name) + 4
    globals_ += record(0x0085, struct.pack("<IBB", at, 0, 0) + name) + record(0x000A, b"")
    packed = lambda v: (v << 2 | 2) & 0xFFFFFFFF
    cells = [
        record(0x00FD, struct.pack("<HHHI", 0, 0, 0, 0)),
        record(0x00FD, struct.pack("<HHHI", 0, 1, 0, 1)),
        record(0x0204, struct.pack("<HHH", 0, 2, 0) + text("C")),
        record(0x0204, struct.pack("<HHH", 0, 3, 0) + text("D")),
        record(0x027E, struct.pack("<HHHI", 1, 0, 0, packed(7))),
        record(0x0203, struct.pack("<HHHd", 1, 1, 1, 46149.0)),
        record(0x0205, struct.pack("<HHHBB", 1, 2, 0, 1, 0)),
        record(0x0006, struct.pack("<HHH", 1, 3, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 6),
        record(0x0207, text("made")),
        record(0x00BD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, packed(-3)) + struct.pack("<HI", 1, packed(46150)) + struct.pack("<H", 1)),
        record(0x00FD, struct.pack("<HHHI", 2, 3, 0, 2)),
    ]
    path = tmp_path / "old.xls"
    path.write_bytes(compound(globals_ + record(0x0809, struct.pack("<HH", 0x0600, 0x10) + b"\0" * 12) + b"".join(cells) + record(0x000A, b"")))
    e = Engine(spark).load(str(path))
    assert result(e, "SELECT * FROM data ORDER BY id DESC") == [(7, datetime.date(2026, 5, 7), True, "made"), (-3, datetime.date(2026, 5, 8), None, "商品ab")]
    (tmp_path / "bad.xls").write_bytes(b"nothing")
    with pytest.raises(LoadError):
        Engine(spark).load(str(tmp_path / "bad.xls"))


def test_records_over_lines_are_split_over_tasks(spark, tmp_path):
    """Records of one line and of many, over blocks much smaller than the file, against Python's reader."""
    import csv
    import random

    pick = random.Random(3)
    rows = [(str(k), pick.choice(["plain", 'say ""hi""', "a\nb", "x,\n\n,y", "é" * 50, "", "line\n" * 40, "end\r"]).replace('""', '"'), str(k * 2)) for k in range(400)]
    path = tmp_path / "data.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([("id", "said", "twice"), *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        e = Engine(spark).load(str(path))
        assert records(spark, str(path)).select("block").distinct().count() > 20
        got = result(e, "SELECT id, said, twice FROM data ORDER BY id")
        assert got == [(int(a), b or None, int(c)) for a, b, c in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
