"""Notebook magics: ``%load_ext situ.notebook``, then ``%situ statement`` or a cell that begins with ``%%situ``."""

from __future__ import annotations

import argparse
import shlex
from typing import Any

from .engine import Engine
from .errors import SituError

_parser = argparse.ArgumentParser(prog="%%situ", add_help=False, exit_on_error=False)
_parser.add_argument("--engine", default="engine", help="the notebook's variable that is the engine")
_parser.add_argument("--to", default="", help="a variable that gets the result")
_parser.add_argument("--rows", type=int, default=40)
_parser.add_argument("--explain", action="store_true")


def run(line: str, cell: str | None, names: dict[str, Any]) -> Any:
    """Runs a cell's statements, or a line's, with the engine that the names hold, or a new one under that name.

    Gives a pandas frame of up to ``--rows`` rows to show, or the plan's text; findings are printed.
    """
    options, rest = _parser.parse_known_args(shlex.split(line) if cell is not None else [])
    if rest:
        raise ValueError(f"unknown option {rest[0]}")
    text = line if cell is None else cell
    if options.engine not in names:
        names[options.engine] = Engine()
    engine = names[options.engine]
    try:
        if options.explain:
            return engine.explain(text)
        result = engine.execute(text)
    except SituError as e:
        print(e.diagnostic.render(text))
        return None
    for d in result.diagnostics:
        print(d)
    if options.to:
        names[options.to] = result
    return result.df.limit(options.rows).toPandas()


def load_ipython_extension(shell: Any) -> None:
    """Registers the magic with a notebook's shell."""
    shell.register_magic_function(lambda line, cell=None: run(line, cell, shell.user_ns), "line_cell", "situ")
