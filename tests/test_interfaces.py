"""Rendering, the JSON lines server and the command line."""

from __future__ import annotations

import io
import json
import subprocess
import sys
from pathlib import Path

import pytest

from tabulon import cli
from tabulon.render import render, shown, width
from tabulon.server import LIMIT, Server
from tabulon.session import Engine

CSV = "id,name,city\n1,alice,LA\n2,bob,NY\n3,carol,\n"


def test_cells():
    assert [shown(x) for x in (20.0, 4.25, None, True, 1e20, 1.5e-7, 0.1 + 0.2, float("inf"), -0.0)] == ["20", "4.25", "NULL", "true", "100000000000000000000", "0.00000015", "0.30000000000000004", "inf", "-0"]


def test_formats():
    rows = [("Alice", 30, float("nan")), ("Dan", None, 2.5)]
    columns = ["name", "a", "a"]
    assert json.loads(render("json", columns, rows)) == [{"a": 30, "a_2": None, "name": "Alice"}, {"a": None, "a_2": 2.5, "name": "Dan"}]
    assert render("csv", ["n", "q"], [('a"b', None)]) == 'n,q\n"a""b",NULL\n'
    assert render("yaml", columns, rows).startswith("- a: 30\n  a_2: null\n  name: Alice\n")
    assert render("yaml", ["a"], [("yes",), ("x: y",)]) == '- a: "yes"\n- a: "x: y"\n'
    table = render("table", ["名", "v"], [("表格", 1.0)])
    assert len({width(line) for line in table.splitlines()}) == 1
    assert render("table", ["name", "age"], [("Alice", 30), ("Dan", 40)]).splitlines()[3:6] == ["│ Alice │ 30  │", "├───────┼─────┤", "│  Dan  │ 40  │"]


@pytest.fixture
def server(spark, tmp_path):
    (tmp_path / "people.csv").write_text(CSV)
    return Server(Engine(spark).load(str(tmp_path / "people.csv")), str(tmp_path))


def ask(server, **request):
    return server.answer(json.dumps(request))


def test_server_query(server):
    got = ask(server, op="query", sql="SELECT name, city FROM people ORDER BY id", id=7, format="csv")
    assert got["ok"] and got["id"] == 7
    assert got["columns"] == ["name", "city"]
    assert got["rows"] == [["alice", "LA"], ["bob", "NY"], ["carol", None]]
    assert got["text"].endswith("carol,NULL\n")
    assert (got["stats"]["input_rows"], got["stats"]["output_rows"]) == (3, 3)
    database = server.engine.catalog.current
    assert ask(server, op="list")["data"]["databases"] == [{"name": database, "tables": [{"name": "people", "columns": ["id", "name", "city"]}]}]
    server.engine.catalog.current = None
    assert ask(server, op="query", sql="SHOW TABLES", db=database)["rows"] == [["people"]]
    assert ask(server, op="query", sql=f"USE {database}")["ok"]
    assert server.engine.catalog.current is None


def test_server_errors(server):
    assert server.answer("{")["code"] == "invalid_json"
    assert server.answer("[1]")["code"] == "invalid_request"
    assert server.answer('{"op": "' + "x" * LIMIT + '"}')["code"] == "invalid_request"
    for request in ({"op": "nope"}, {"op": "query"}, {"op": "query", "sql": "SELECT 1", "format": "xml"}, {"op": "export", "sql": "SELECT 1"}):
        assert ask(server, **request)["code"] == "invalid_request"
    assert ask(server, op="query", sql="SELECT nope FROM people", id="a") | {"elapsed_ms": 0, "error": ""} == {"ok": False, "code": "query_error", "error": "", "elapsed_ms": 0, "id": "a"}
    assert ask(server, op="query", sql="SELECT 1", db="nope")["code"] == "query_error"
    assert ask(server, op="query", sql="SELECT 1 / 0")["code"] == "query_error"


def test_server_export(server, tmp_path):
    assert ask(server, op="export", sql="SELECT id FROM people ORDER BY id", path="out.csv")["ok"]
    assert (tmp_path / "out.csv").read_text() == "id\n1\n2\n3\n"
    assert ask(server, op="export", sql="SELECT 1", path="out.csv")["code"] == "export_error"
    assert ask(server, op="export", sql="SELECT 1 AS x", path="out.csv", overwrite=True)["ok"]
    assert (tmp_path / "out.csv").read_text() == "x\n1\n"
    (tmp_path / "link").symlink_to("/tmp")
    for path in ("/tmp/x.csv", "../x.csv", "link/x.csv"):
        assert ask(server, op="export", sql="SELECT 1", path=path)["code"] == "invalid_request"


def test_server_loop(server):
    out = io.StringIO()
    server.serve(['{"op":"list"}\n', "\n", '{"op":"exit"}\n', '{"op":"list"}\n'], out)
    assert [json.loads(x)["ok"] for x in out.getvalue().splitlines()] == [True, True]


@pytest.mark.parametrize("argv", [["-x"], ["-S", "-q", "SELECT 1"], ["-s", "a.csv"], ["--export-root", "x"], ["-o", "xml"], ["-ps", "0"], ["--max-rows", "0"], ["--delimiter", "ab"], ["-f"]])
def test_bad_arguments(argv, capsys):
    assert cli.main(argv) == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "people.csv"
    path.write_text(CSV)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["-f", str(path), "-q", "SELECT id FROM people WHERE city IS NOT NULL ORDER BY id", "-o", "csv", "-a", "-s", str(tmp_path / "r.csv")]) == 0
    out = capsys.readouterr().out
    assert out.startswith("id\n1\n2\n2 rows in set (") and out.endswith("scanned 3 row(s)\n")
    assert (tmp_path / "r.csv").read_text() == "id\n1\n2\n"
    assert cli.main(["-f", str(path), "-q", "SELECT nope FROM people"]) == 4
    assert cli.main(["-f", str(tmp_path / "none.csv"), "-q", "SELECT 1"]) == 3
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n\n"))
    assert cli.main(["-f", str(path), "-q", "SELECT id FROM people", "-p", "-ps", "2"]) == 0
    assert "[Page 1/2 - Press Enter to continue]" in capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO("SELECT nope\nSELECT name FROM people WHERE id = 2\nexit\nSELECT 1\n"))
    assert cli.main(["-f", str(path)]) == 0
    got = capsys.readouterr()
    assert "bob" in got.out and got.out.count("╭") == 1 and got.err.startswith("Error: ")


def test_version_needs_no_session():
    done = subprocess.run([sys.executable, "-m", "tabulon", "--version"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=60, check=False)
    assert done.returncode == 0 and done.stdout.startswith("tabulon ")
