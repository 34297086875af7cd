"""A safe filter language over trace columns: ``col op value [AND|OR col op value ...]``.

Values are typed by column, ``AND`` binds tighter than ``OR``; nothing of the text reaches SQL.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARACTERS = 1024
#: Allowed columns and how their values are read.
COLUMNS = {
    "trace_id": str,
    "model_id": str,
    "user_id": str,
    "service_name": str,
    "provider": str,
    "status": str,
    "latency_ms": float,
    "input_tokens": int,
    "output_tokens": int,
    "cost_micros": int,
    "feature_id": str,
    "environment": str,
    "error_type": str,
    "eval_score": float,
    "drift_score": float,
    "toxicity_score": float,
}
_COMPARE = {
    "=": Column.__eq__,
    "!=": Column.__ne__,
    "<>": Column.__ne__,
    "<": Column.__lt__,
    ">": Column.__gt__,
    "<=": Column.__le__,
    ">=": Column.__ge__,
}
_TOKEN = re.compile(r"\s*(?:'((?:[^']|'')*)'|(<=|>=|!=|<>|[=<>(),])|([^\s'(),=<>!]+))")


class FilterError(ValueError):
    """The text is no filter of this language."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind ``value`` for quoted strings, ``mark`` and ``word``."""
    if len(text) > MOST_CHARACTERS:
        raise FilterError(f"longer than {MOST_CHARACTERS} characters")
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise FilterError(f"unexpected text at {at}")
        quoted, mark, word = match.groups()
        out.append(("value", quoted.replace("''", "'")) if quoted is not None else ("mark", mark) if mark else ("word", word))
        at = match.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.left = tokens(text)

    def take(self, *wanted: str) -> str:
        if not self.left:
            raise FilterError("ends too early")
        kind, text = self.left.pop(0)
        if wanted and (kind == "value" or text.upper() not in wanted):
            raise FilterError(f"{text!r} where {' or '.join(wanted)} should stand")
        return text

    def at(self, *wanted: str) -> bool:
        return bool(self.left) and self.left[0][0] != "value" and self.left[0][1].upper() in wanted

    def values(self, kind) -> list:
        self.take("(")
        out = [self.value(kind)]
        while not self.at(")"):
            self.take(",")
            out.append(self.value(kind))
        self.take(")")
        return out

    def value(self, kind):
        try:
            return kind(self.take())
        except ValueError as error:
            raise FilterError(str(error)) from error

    def predicate(self) -> Column:
        name = self.take()
        if name not in COLUMNS:
            raise FilterError(f"unknown column {name!r}")
        column, kind = F.col(name), COLUMNS[name]
        if self.at(*_COMPARE):
            return _COMPARE[self.take()](column, self.value(kind))
        if self.at("IS"):
            self.take()
            negated = self.at("NOT") and bool(self.take())
            self.take("NULL")
            return column.isNotNull() if negated else column.isNull()
        negated = self.at("NOT") and bool(self.take())
        operator = self.take("IN", "LIKE", "BETWEEN").upper()
        if operator == "IN":
            found = column.isin(*self.values(kind))
        elif operator == "LIKE":
            found = column.like(self.value(str))
        else:
            low = self.value(kind)
            self.take("AND")
            found = column.between(low, self.value(kind))
        return ~found if negated else found


def parse(text: str) -> Column:
    """The filter as a column expression."""
    reader = _Reader(text)
    either: list[list[Column]] = [[reader.predicate()]]
    while reader.left:
        if reader.take("AND", "OR").upper() == "OR":
            either.append([])
        either[-1].append(reader.predicate())
    return reduce(Column.__or__, (reduce(Column.__and__, both) for both in either))
