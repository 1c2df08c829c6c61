"""Directives in comments: ``@mark [request|response] name[=json] ...``, one directive a line.

Other lines are prose: the first is the summary, the rest the description.
A line is first read into tokens; rules then judge all tokens of a comment, and
the fault that stands first counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 65_536
# The names that a directive may assign.
NAMES = set(
    "required nonnull nullable operationId tags deprecated ignore enum const default examples format pattern minLength maxLength "
    "minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems uniqueItems minContains maxContains "
    "minProperties maxProperties readOnly writeOnly contentEncoding contentMediaType title description mediaType type status".split()
)
# What a directive may be about.
KINDS = ("request", "response")
#: A name, and the sign that a value follows; spaces may stand before the value.
_HEAD = re.compile(r"(?P<name>[A-Za-z]+)(?P<sign>=(?P<space>\s*))?")
_SPACES = re.compile("[ \t]+|$")
#: What frames a comment's line.
_FRAME = re.compile(r"\s*(?://)?\s*(?:/\*)?\s*(?P<text>.*?)\s*(?:\*/)?\s*", re.DOTALL)


def _no_constant(name: str):
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_no_constant)


class Problem(ValueError):
    """A code and the line and column, from one, that it is about."""

    def __init__(self, code: str, line: int, column: int):
        super().__init__(code)
        self.code, self.line, self.column = code, line, column


@dataclass
class Comment:
    summary: str = ""
    description: str = ""
    #: (line, kind, name, JSON text)
    values: list[tuple[int, str, str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Token:
    """A name of a line, with the JSON text given for it; with a code, what can't be read from there on."""

    line: int
    place: int
    column: int
    name: str = ""
    value: str | None = None
    code: str | None = None


def tokens(line: str, number: int, start: int) -> Iterator[Token]:
    """The tokens of a line after its mark, which ends at ``start``."""
    gap = _SPACES.match(line, start)
    if not gap:
        yield Token(number, 0, start + 1, code="comment.syntax")
        return
    at, place = gap.end(), 0
    while at < len(line):
        head = _HEAD.match(line, at)
        if not head:
            yield Token(number, place, at + 1, code="comment.syntax")
            return
        end = head.end()
        if head["sign"]:
            try:
                _, end = _JSON.raw_decode(line, head.end())
            except (ValueError, RecursionError):
                yield Token(number, place, head.end("name") + 2, code="comment.json")
                return
        gap = _SPACES.match(line, end)
        if not gap:
            yield Token(number, place, end + 1, code="comment.syntax")
            return
        yield Token(number, place, at + 1, head["name"], line[head.end() : end] if head["sign"] else None)
        at, place = gap.end(), place + 1


def _is_kind(token: Token) -> bool:
    return token.place == 0 and token.name in KINDS and token.value is None and not token.code


def _faults(found: list[Token], marked: list[int]) -> Iterator[tuple[int, int, str, int]]:
    """(line, place, code, column) of all that is wrong with a comment's tokens; ``marked`` are its directives' lines."""
    kinds = {t.line for t in found if _is_kind(t)}
    named = [t for t in found if not _is_kind(t) and not t.code]
    yield from ((t.line, t.place, t.code, t.column) for t in found if t.code)
    yield from ((t.line, t.place, "comment.unknown", t.column) for t in named if t.name not in NAMES)
    # a line says nothing twice; lines about no kind agree with each other
    first: dict[tuple, str | None] = {}
    for t in named:
        if (t.line, t.name) in first or (t.line not in kinds and first.get(t.name, t.value or "true") != (t.value or "true")):
            yield t.line, t.place, "comment.conflict", t.column
        first[t.line, t.name] = t.value
        if t.line not in kinds:
            first.setdefault(t.name, t.value or "true")
    says = {t.line for t in found if not _is_kind(t)}
    yield from ((line, 0, "comment.syntax", 1) for line in marked if line not in says)


def parse(text: str, mark: str) -> Comment:
    """The directives and prose of a comment; raises ``Problem`` at the first fault."""
    if len(text.encode()) > MAX_BYTES:
        raise Problem("comment.budget", 1, 1)
    lines = [(number, _FRAME.fullmatch(raw)["text"]) for number, raw in enumerate(text.split("\n"), 1)]
    marked = [(number, line) for number, line in lines if line.startswith(mark)]
    found = [t for number, line in marked for t in tokens(line, number, len(mark))]
    fault = min(_faults(found, [number for number, _ in marked]), default=None)
    if fault:
        raise Problem(fault[2], fault[0], fault[3])
    values = []
    for number, own in groupby(found, lambda t: t.line):
        own = list(own)
        kind = own[0].name if _is_kind(own[0]) else ""
        values += [(number, kind, t.name, t.value or "true") for t in own[bool(kind) :]]
    prose = "\n".join(line for _, line in lines if not line.startswith(mark)).strip()
    summary, _, description = prose.partition("\n")
    return Comment(summary, description.strip(), values)


def directives(comments: DataFrame, mark: str) -> DataFrame:
    """``id, line, kind, name, value, code, column`` of ``comments(id string, text string)``.

    A comment with a fault gives one row with its code; one without directives
    gives none; null text gives none.
    """
    schema = pa.schema(
        [("id", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("code", pa.string()), ("column", pa.int32())]
    )

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(i, *v, None, None) for v in parse(text or "", mark).values]
                except Problem as p:
                    rows.append((i, p.line, None, None, None, p.code, p.column))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return comments.select("id", "text").mapInArrow(
        run, "id string, line int, kind string, name string, value string, code string, column int"
    )
