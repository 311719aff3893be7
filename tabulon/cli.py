"""The command line: one query, a JSONL server, or statements from a terminal or a pipe."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tabulon.errors import LoadError, QueryError
from tabulon.render import FORMATS, render, write_csv
from tabulon.session import Engine, check_file, expand

VERSION = "0.1.0"
# Exit codes.
FAILED, BAD_ARGUMENTS, BAD_FILES, BAD_QUERY = 1, 2, 3, 4


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be greater than zero")
    return value


def one_ascii(text: str) -> str:
    if len(text) != 1 or not text.isascii():
        raise argparse.ArgumentTypeError("must be one ASCII character")
    return text


def output(text: str) -> str:
    if text.lower() not in FORMATS:
        raise argparse.ArgumentTypeError("expected one of: render, json, csv, yaml")
    return FORMATS[text.lower()]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabulon", description="Query CSV and spreadsheet files with SQL.", allow_abbrev=False)
    p.add_argument("-f", "--files", nargs="+", action="extend", default=[], help="files or patterns to load")
    p.add_argument("-q", "--query", help="run one statement and exit")
    p.add_argument("-a", "--analysis", action="store_true", help="print rows, time and rows scanned")
    p.add_argument("-p", "--pagination", action="store_true", help="show tables in pages")
    p.add_argument("-ps", "--pagesize", type=positive, default=10, help="rows a page")
    p.add_argument("-o", "--output", type=output, default="table", help="render, json, csv or yaml")
    p.add_argument("-s", "--save", help="also write the result as CSV")
    p.add_argument("-S", "--server", action="store_true", help="answer JSON lines")
    p.add_argument("--export-root", help="directory that the server's exports stay in")
    p.add_argument("--max-rows", type=positive, help="refuse tables with more rows")
    p.add_argument("--max-file-bytes", type=positive, help="refuse larger files")
    p.add_argument("--delimiter", type=one_ascii, default=",", help="CSV delimiter")
    p.add_argument("--no-header", action="store_true", help="CSV files have no header")
    p.add_argument("--null-value", help="CSV text that means NULL")
    p.add_argument("-v", "--version", action="version", version=f"tabulon {VERSION}")
    return p


def parsed(argv: list[str] | None) -> argparse.Namespace:
    p = arguments()
    args = p.parse_args(argv)
    if args.server and (args.query is not None or args.save is not None):
        p.error("--server cannot be combined with --query or --save")
    if args.save is not None and args.query is None:
        p.error("--save requires --query")
    if args.export_root is not None and not args.server:
        p.error("--export-root requires --server")
    return args


def session() -> SparkSession:
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"}
    builder = SparkSession.builder.appName("tabulon")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def show(args: argparse.Namespace, columns: list[str], rows: list[tuple]) -> None:
    if args.output != "table" or not args.pagination or len(rows) <= args.pagesize:
        sys.stdout.write(render(args.output, columns, rows))
        return
    pages = -(-len(rows) // args.pagesize)
    for k in range(pages):
        sys.stdout.write(render("table", columns, rows[k * args.pagesize : (k + 1) * args.pagesize]))
        if k + 1 < pages:
            print(f"\n[Page {k + 1}/{pages} - Press Enter to continue]", end="", flush=True)
            sys.stdin.readline()


def one_query(engine: Engine, args: argparse.Namespace) -> None:
    began = time.perf_counter()
    result = engine.run(args.query, stats=args.analysis)
    taken = time.perf_counter() - began
    show(args, result.columns, result.rows)
    if args.save is not None:
        write_csv(args.save, result.columns, result.rows, overwrite=True)
    if args.analysis:
        n = len(result.rows)
        print(f"{n} row{'' if n == 1 else 's'} in set ({taken:.3f}s); scanned {result.stats.input_rows} row(s)")


def statements(engine: Engine, lines, interactive: bool) -> None:
    """A statement a line; errors go to stderr and the next line follows."""
    while True:
        if interactive:
            print("> ", end="", flush=True)
        line = lines.readline()
        if not line or line.strip().rstrip(";").lower() in ("exit", "quit"):
            return
        if not line.strip():
            continue
        try:
            result = engine.run(line, stats=False)
            sys.stdout.write(render("table", result.columns, result.rows))
            sys.stdout.flush()
        except (QueryError, PySparkException) as error:
            print(f"Error: {error}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    try:
        args = parsed(argv)
    except SystemExit as stop:
        return stop.code if isinstance(stop.code, int) else BAD_ARGUMENTS
    try:
        for path in expand(args.files):
            check_file(path, args.max_file_bytes)
        engine = Engine(session()).load(args.files, args.max_rows, args.max_file_bytes, args.delimiter, not args.no_header, args.null_value)
    except (LoadError, PySparkException) as error:
        print(f"Error: {error}", file=sys.stderr)
        return BAD_FILES
    try:
        if args.server:
            from tabulon.server import Server

            Server(engine, args.export_root).serve(sys.stdin, sys.stdout)
        elif args.query is not None:
            one_query(engine, args)
        else:
            statements(engine, sys.stdin, sys.stdin.isatty())
    except (QueryError, PySparkException, OSError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return BAD_QUERY if args.query is not None else FAILED
    return 0


if __name__ == "__main__":
    sys.exit(main())
