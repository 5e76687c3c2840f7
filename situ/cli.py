"""Command line: python -m situ.cli [--table name=path.parquet] [--output table|json|csv] [statement].

Without a statement it reads statements from the input, each up to its semicolon, and goes on after errors.
"""

from __future__ import annotations

import argparse
import sys

from .engine import Engine
from .errors import SituError
from .result import Result


def main(argv: list[str] | None = None) -> int:
    """Runs statements and prints the last one's rows."""
    parser = argparse.ArgumentParser(prog="situ")
    parser.add_argument("statement", nargs="?", help="statements, or @file; without, they are read from the input")
    parser.add_argument("--table", action="append", default=[], help="name=path of a Parquet table")
    parser.add_argument("--output", choices=("table", "json", "csv"), default="table")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--rows", type=int, default=40)
    args = parser.parse_args(argv)
    engine = Engine()
    for t in args.table:
        name, _, path = t.partition("=")
        engine.register_table(name, path)
    if args.statement is None:
        return _prompt(engine, args)
    text = open(args.statement[1:], encoding="utf-8").read() if args.statement[:1] == "@" else args.statement
    if args.explain:
        print(engine.explain(text))
        return 0
    _print(engine.execute(text), args)
    return 0


def _print(result: Result, args: argparse.Namespace) -> None:
    if args.output == "table":
        result.show(args.rows)
    elif args.output == "csv":
        sys.stdout.write(result.df.limit(args.rows).toPandas().to_csv(index=False))
    else:
        for line in result.df.limit(args.rows).toJSON().collect():
            print(line)


def _prompt(engine: Engine, args: argparse.Namespace) -> int:
    """Reads and runs statements until the input ends or says exit."""
    kept = ""
    while True:
        if sys.stdin.isatty():
            print("   ... " if kept else "situ> ", end="", flush=True)
        line = sys.stdin.readline()
        if not line or not kept and line.strip().rstrip(";").lower() in ("exit", "quit"):
            return 0
        kept += line
        if not kept.rstrip().endswith(";"):
            kept = kept if kept.strip() else ""
            continue
        text, kept = kept, ""
        try:
            _print(engine.execute(text), args)
        except SituError as e:
            print(e.diagnostic.render(text))
        except Exception as e:  # the prompt goes on
            print(f"error: {str(e).splitlines()[0]}")


if __name__ == "__main__":
    sys.exit(main())
