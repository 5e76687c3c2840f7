"""Errors and diagnostics."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

#: The language's codes and what they mean.
CODES = {
    "E001": "syntax error",
    "E002": "unexpected token",
    "E003": "string without an end",
    "E004": "invalid number",
    "E100": "undefined context",
    "E102": "entity key types do not match",
    "E103": "circular dependency",
    "E105": "several event logs match",
    "E107": "ORDER BY CONTEXT without a context predicate",
    "E108": "context score without a context predicate",
    "E109": "context is not temporal",
    "E110": "negative weight",
    "E111": "score is not numeric",
    "E112": "context is retired",
    "E113": "context name exists already",
    "E114": "context's query lacks the entity key",
    "E115": "parameter was not declared",
    "E116": "parameter was declared twice",
    "E117": "composed contexts have different keys",
    "E118": "ORDER BY in a context's definition",
    "E120": "context without an entity key",
    "E130": "event log without a source",
    "E131": "event log without a case column",
    "E132": "event log without an activity column",
    "E133": "event log without a timestamp column",
    "E140": "process model without paths",
    "E141": "process model of an undefined event log",
    "E302": "provider's entity type does not match",
    "W001": "context window over contexts without scores",
    "W002": "joined query without CONTEXT ON",
    "W003": "score outside 0 to 1",
    "W004": "weight of zero",
    "W010": "context is stale",
    "W012": "context is very stale",
}
#: Codes of this engine for what the language's codes leave out.
OWN_CODES = {
    "E201": "unknown table",
    "E202": "unknown event log",
    "E203": "unknown process model",
    "E204": "unknown provider, or one without an implementation",
    "E205": "no entity key column in the query",
    "E206": "wrong context arguments",
    "E207": "context window without a predicate",
    "E208": "missing privilege",
    "E209": "name exists already",
    "E210": "unknown column of an event log",
    "E211": "context is used by others",
    "W101": "provider did not answer in time",
    "W102": "context is not active",
    "W103": "ranking by contexts without scores",
    "W104": "ranking without a limit",
}


@dataclass(frozen=True)
class Diagnostic:
    """One finding; ``at`` is its place in the text, if it has one."""

    code: str
    message: str
    hint: str = ""
    at: int = -1

    @property
    def severity(self) -> str:
        """error or warning."""
        return "error" if self.code[0] == "E" else "warning"

    def __str__(self) -> str:
        return f"{self.severity}[{self.code}]: {self.message}" + (f"\n  hint: {self.hint}" if self.hint else "")

    def render(self, text: str) -> str:
        """The finding with its line of the text and a mark below its place."""
        if not 0 <= self.at <= len(text):
            return str(self)
        start = text.rfind("\n", 0, self.at) + 1
        line, number, column = text[start:].split("\n", 1)[0], text.count("\n", 0, self.at) + 1, self.at - start
        head, *rest = str(self).split("\n", 1)
        return "\n".join([head, f"  --> {number}:{column + 1}", f"   | {line}", f"   | {' ' * column}^", *rest])


class SituError(ValueError):
    """A statement that cannot be run."""

    def __init__(self, code: str, message: str, hint: str = "", at: int = -1):
        self.diagnostic = Diagnostic(code, message, hint, at)
        super().__init__(str(self.diagnostic))

    @property
    def code(self) -> str:
        """The diagnostic's code."""
        return self.diagnostic.code


def did_you_mean(name: str, known: list[str]) -> str:
    """A hint with the nearest known name, if there is one."""
    near = difflib.get_close_matches(name.lower(), [k.lower() for k in known], 1, 0.6)
    return f"did you mean {near[0]}?" if near else ""
