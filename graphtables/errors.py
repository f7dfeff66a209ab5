"""Errors of the engine; those with a place in a query show it."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    """Byte offsets of a piece of query text, the end not included."""

    start: int
    end: int

    def to(self, other: Span) -> Span:
        return Span(min(self.start, other.start), max(self.end, other.end))


class GraphError(Exception):
    """Anything that the engine refuses."""


class CypherError(GraphError):
    """A query that cannot be parsed, bound or lowered.  ``str()`` shows the place."""

    def __init__(self, message: str, span: Span, text: str = ""):
        self.message, self.span, self.text = message, span, text
        super().__init__(message)

    def within(self, text: str) -> CypherError:
        self.text = text
        return self

    def __str__(self) -> str:
        return f"{self.message}\n{render(self.text, self.span)}" if self.text else self.message


class ParseError(CypherError):
    pass


class BindError(CypherError):
    pass


def unsupported(what: str, span: Span) -> BindError:
    return BindError(f"unsupported: {what}", span)


def render(text: str, span: Span) -> str:
    """The line that a span begins in, with line and column and marks below it."""
    data = text.encode()
    start = min(span.start, len(data))
    before = data[:start].decode(errors="replace")
    number = before.count("\n") + 1
    column = len(before) - (before.rfind("\n") + 1)
    lines = text.split("\n")
    line = lines[number - 1] if number <= len(lines) else ""
    width = len(data[start : max(span.end, start)].decode(errors="replace").split("\n")[0])
    return f"  --> line {number}:{column + 1}\n{line}\n{' ' * column}{'^' * max(1, width)}"
