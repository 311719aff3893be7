"""Statements over a folder that gets files."""

from __future__ import annotations

import pytest

from tabulon.errors import UnsupportedError
from tabulon.session import Engine
from tabulon.streaming.continuous import register_csv_folder, writer


def test_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("city,n\nNY,1\nLA,2\n")
    e = Engine(spark)
    register_csv_folder(e, "sales", str(folder), "city string, n long")
    groups = writer(e, "SELECT city, SUM(n) AS total FROM sales GROUP BY city").format("memory").queryName("groups").start()
    rows = writer(e, "SELECT city || '!' AS c FROM sales WHERE n BETWEEN 2 AND 9").format("memory").queryName("rows").start()
    try:
        groups.processAllAvailable()
        (folder / "b.csv").write_text("city,n\nNY,5\n")
        for q in (groups, rows):
            q.processAllAvailable()
        assert {tuple(r) for r in spark.table("groups").collect()} == {("NY", 6), ("LA", 2)}
        assert {r[0] for r in spark.table("rows").collect()} == {"LA!", "NY!"}
    finally:
        groups.stop()
        rows.stop()
    e.register("fixed", spark.range(1).toDF("x"))
    with pytest.raises(UnsupportedError):
        writer(e, "SELECT x FROM fixed")
