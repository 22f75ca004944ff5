"""Command line: one database, one command."""

from __future__ import annotations

import argparse
import struct
import sys
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import SparkSession

from . import errors as E
from .engine import Engine
from .sources.catalog import Catalog, parse_schema
from .sources.csv import import_csv, import_csv_file
from .sources.jsonl import export_jsonl
from .sources.lineitem import load_lineitem
from .sources.parquet import export_parquet, import_parquet

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pipeloom", description=__doc__, allow_abbrev=False)
    top.add_argument("--version", action="version", version=_version())
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **more: dict) -> None:
        sub = commands.add_parser(name, allow_abbrev=False)
        sub.add_argument("--database", required=True)
        for budget in ("memory-limit-bytes", "temp-limit-bytes"):  # checked, then left to Spark's own memory management
            sub.add_argument(f"--{budget}", type=positive)
        for option in options:
            sub.add_argument(f"--{option}", required=True)
        for option, how in more.items():
            sub.add_argument(f"--{option.replace('_', '-')}", **how)

    number = {"type": positive}
    batches = dict.fromkeys(("record_limit_bytes", "field_limit_bytes", "batch_rows", "batch_text_bytes", "batch_limit", "encoded_limit_bytes"), number)
    groups = dict.fromkeys(("metadata_limit_bytes", "row_group_limit", "row_group_rows", "row_group_limit_bytes", "row_group_text_bytes", "page_limit_bytes"), number)
    command("create-declared")
    command("create")
    command("open")
    command("reclaim")
    command("declare", "schema-file")
    command("schema", "table")
    command("load", "input")
    command("import", "table", "input", format={"choices": ("csv", "parquet"), "default": "csv"}, row_limit=number, input_limit_bytes=number, **batches, **groups)
    command("query", "query-file")
    command("explain", "query-file")
    command("export", "query-file", format={"choices": ("jsonl", "parquet"), "default": "jsonl"}, row_limit=number, output_limit_bytes=number, output={}, **groups)
    command("resolve", "transaction")
    return top


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise ValueError("a limit is positive")
    return value


def _version() -> str:
    try:
        return version("pipeloom")
    except PackageNotFoundError:
        return VERSION


def tagged(value: object, type_: str) -> str:
    """A cell of diagnostic output, with its type."""
    if value is None:
        return "null"
    if type_ == "DOUBLE":
        return f"double:{value!r}:{struct.pack('>d', value).hex()}"
    return {"INT64": lambda: f"int64:{value}", "STRING": lambda: f"string:{value.encode().hex()}", "DATE": lambda: f"date:{value.isoformat()}"}[type_]()


def read_text(path: str) -> str:
    with open(path, "rb") as f:
        return f.read().decode()


def execute(args: argparse.Namespace, spark: SparkSession) -> None:
    say = lambda *lines: print(*lines, sep="\n")
    if args.command in ("create", "create-declared"):
        Catalog.create(spark, args.database)
        return say("status=created")
    catalog = Catalog(spark, args.database)
    if args.command == "open":
        return say("status=opened", f"generation={catalog.snapshot().generation}")
    if args.command == "reclaim":
        return say("status=reclaimed", f"objects={catalog.reclaim()}")
    if args.command == "declare":
        with open(args.schema_file, "rb") as f:
            generation, token = catalog.declare_table(*parse_schema(f.read()))
        return say("status=declared", f"generation={generation}", f"transaction={token}")
    if args.command == "schema":
        found = catalog.inspect_table(args.table)
        lines = [f"column[{k}]={n}:{t.lower()}:{'nullable' if null else 'required'}" for k, (n, t, null) in enumerate(found.columns)]
        return say("status=inspecting", f"table={found.name}", f"generation={found.generation}", f"column_count={len(lines)}", *lines, "status=inspected")
    if args.command == "load":
        generation, token = load_lineitem(catalog, args.input)
        return say("status=loaded", f"generation={generation}", f"transaction={token}")
    if args.command == "import":
        limits = {name: value for name, value in (("record_limit", args.record_limit_bytes), ("field_limit", args.field_limit_bytes)) if value}
        if args.format == "parquet":
            generation, token = import_parquet(catalog, args.table, args.input, args.row_limit)
        elif args.input == "-":
            generation, _, token = import_csv(catalog, args.table, sys.stdin.buffer, args.input_limit_bytes, args.row_limit, **limits)
        else:
            generation, _, token = import_csv_file(catalog, args.table, args.input, args.input_limit_bytes, args.row_limit, **limits)
        return say("status=imported", f"generation={generation}", f"transaction={token}")
    if args.command == "resolve":
        generation = catalog.resolve(args.transaction)
        return say("status=not-found" if generation is None else f"status=durable\ngeneration={generation}")
    prepared = Engine(spark, catalog).prepare(read_text(args.query_file))
    if args.command == "explain":
        return say("status=explaining", prepared.logical_plan().rstrip("\n"), "status=explained")
    if args.command == "query":
        columns = prepared.columns
        described = ",".join(f"{n or ''}:{t.lower()}:{'nullable' if null else 'required'}" for n, t, null in columns)
        say("status=querying", f"column_count={len(columns)}", f"columns={described}")
        rows = 0
        for batch in prepared.batches():
            for row in batch:
                rows += 1
                print("row=" + "|".join(tagged(v, t) for v, (_, t, _) in zip(row, columns, strict=True)))
        return say(f"row_count={rows}", "status=queried")
    if args.format == "parquet":
        if not args.output:
            raise E.InputError("parquet export needs --output")
        return export_parquet(prepared, args.output)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            export_jsonl(prepared, f, args.row_limit, args.output_limit_bytes)
    else:
        export_jsonl(prepared, sys.stdout, args.row_limit, args.output_limit_bytes)
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0 done, 1 failed, 2 wrong usage."""
    args = parser().parse_args(argv)
    try:
        execute(args, spark or SparkSession.builder.appName("pipeloom").getOrCreate())
    except (E.PipeError, OSError) as e:
        print(f"error={type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
