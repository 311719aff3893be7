"""A line-delimited JSON service over one engine: a request a line in, a response a line out."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable
from pathlib import Path
from typing import Any, TextIO

from pyspark.errors import PySparkException

from tabulon.errors import QueryError
from tabulon.render import FORMATS, plain, render, write_csv
from tabulon.session import Engine

#: The longest request, in bytes.
LIMIT = 1 << 20
OPERATIONS = ("query", "list", "export", "exit")


def failure(code: str, message: str) -> dict[str, Any]:
    return {"ok": False, "code": code, "error": message}


class Server:
    def __init__(self, engine: Engine, export_root: str | None = None):
        self.engine, self.export_root, self.done = engine, export_root, False

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        """Answers each line until `exit` or the end."""
        for line in lines:
            if not line.strip():
                continue
            out.write(json.dumps(self.answer(line), ensure_ascii=False) + "\n")
            out.flush()
            if self.done:
                return

    def answer(self, line: str) -> dict[str, Any]:
        if len(line.encode("utf-8", "surrogatepass")) > LIMIT:
            return failure("invalid_request", f"Request is longer than {LIMIT} bytes")
        try:
            request = json.loads(line)
        except ValueError as error:
            return failure("invalid_json", f"Invalid JSON: {error}")
        if not isinstance(request, dict):
            return failure("invalid_request", "A request is a JSON object")
        response = self.handle(request)
        if "id" in request:
            response["id"] = request["id"]
        return response

    def handle(self, request: dict[str, Any]) -> dict[str, Any]:
        op = request.get("op")
        if op not in OPERATIONS:
            return failure("invalid_request", f"Unknown op `{op if isinstance(op, str) else ''}`, expected one of: {', '.join(OPERATIONS)}")
        return getattr(self, op)(request)

    def exit(self, _: dict[str, Any]) -> dict[str, Any]:
        self.done = True
        return {"ok": True}

    def list(self, _: dict[str, Any]) -> dict[str, Any]:
        catalog = self.engine.catalog
        databases = [{"name": d.name, "tables": [{"name": t.name, "columns": t.frame.columns} for t in d.tables.values()]} for d in catalog.databases.values()]
        return {"ok": True, "data": {"current": catalog.current, "databases": databases}}

    def scoped(self, request: dict[str, Any], act, code: str) -> dict[str, Any]:
        """Runs act with the request's database as the current one, which is always put back; adds the time."""
        catalog, began = self.engine.catalog, time.perf_counter()
        previous = catalog.current
        try:
            if isinstance(request.get("db"), str):
                catalog.use(request["db"])
            response = act()
        except (QueryError, PySparkException, OSError) as error:
            response = failure(code, str(error))
        finally:
            catalog.current = previous
        response["elapsed_ms"] = int((time.perf_counter() - began) * 1000)
        return response

    def query(self, request: dict[str, Any]) -> dict[str, Any]:
        sql, form = request.get("sql"), request.get("format", "json")
        if not isinstance(sql, str) or not sql:
            return failure("invalid_request", "query requires a non-empty `sql`")
        kind = FORMATS.get(form.lower()) if isinstance(form, str) else None
        if kind is None:
            return failure("invalid_request", f"Unknown format `{form}`, expected one of: json, csv, yaml, table")

        def act() -> dict[str, Any]:
            result = self.engine.run(sql)
            rows = [[plain(v) for v in r] for r in result.rows]
            return {"ok": True, "columns": result.columns, "rows": rows, "text": render(kind, result.columns, result.rows), "stats": vars(result.stats).copy()}

        return self.scoped(request, act, "query_error")

    def export(self, request: dict[str, Any]) -> dict[str, Any]:
        sql, path = request.get("sql"), request.get("path")
        if not isinstance(sql, str) or not sql:
            return failure("invalid_request", "export requires a non-empty `sql`")
        if not isinstance(path, str) or not path:
            return failure("invalid_request", "export requires a `path`")
        try:
            target = self.inside(path)
        except ValueError as error:
            return failure("invalid_request", str(error))
        overwrite = request.get("overwrite") is True

        def act() -> dict[str, Any]:
            if target.exists() and not overwrite:
                return failure("export_error", f"Output file `{target}` already exists")
            plan = self.engine.planned(sql)
            write_csv(target, plan.titles, (tuple(r) for r in plan.frame.toLocalIterator()), overwrite)
            return {"ok": True, "path": str(target)}

        return self.scoped(request, act, "export_error")

    def inside(self, path: str) -> Path:
        """The file to write: anywhere, or relative and within the export root, links followed."""
        if self.export_root is None:
            return Path(path)
        if os.path.isabs(path) or ".." in Path(path).parts:
            raise ValueError("Export path must be relative and cannot contain `..`")
        target = Path(self.export_root) / path
        if not target.resolve().is_relative_to(Path(self.export_root).resolve()):
            raise ValueError("Export path must stay within the export root")
        return target
