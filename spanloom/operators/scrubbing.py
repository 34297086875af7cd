"""Personal data and secrets taken out of every string of a table, however deep it lies.

Structs, arrays and maps are walked by their schema, with functions that Spark compiles.  Strings that are JSON
documents are walked by their content, in batches of Python, so that what they hold stays valid JSON.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names, patterns and what stands in their place, applied in this order.
PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone", r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "[PHONE_REDACTED]"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN_REDACTED]"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[CARD_REDACTED]"),
    ("api_key", r"(?i)\b(?:sk|pk|api|key|token|secret|password|auth)[_-]?[A-Za-z0-9]{20,}\b", "[API_KEY_REDACTED]"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9\-_]+\.?[A-Za-z0-9\-_]*\.?[A-Za-z0-9\-_]*", "Bearer [TOKEN_REDACTED]"),
    ("aws_access_key", r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b", "[AWS_KEY_REDACTED]"),
    ("aws_secret_key", r"\b[A-Za-z0-9/+=]{40}\b", "[AWS_SECRET_REDACTED]"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    ("password_field", r"""(?i)(?:password|passwd|pwd|secret|credential)["\s:=]+["']?[^\s"']+["']?""", "[PASSWORD_REDACTED]"),
    ("url_with_creds", r"(?:https?://)[^\s:]+:[^\s@]+@[^\s]+", "[URL_WITH_CREDS_REDACTED]"),
]

# The shorter list of clients that scrub attributes only; letters in either case.
CLIENT_PATTERNS = [
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    ("phone", r"(?i)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    ("ssn", r"(?i)\b\d{3}[-]?\d{2}[-]?\d{4}\b", "[SSN]"),
    ("digits", r"(?i)\b\d{16}\b", "[CARD]"),
    ("card", r"(?i)\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", "[CARD]"),
    ("api_key", r"(?i)\bapi[_-]?key[_-]?[a-zA-Z0-9]{16,}\b", "[API_KEY]"),
    ("secret_key", r"(?i)\b(?:sk|pk)[-_][a-zA-Z0-9]{24,}\b", "[SECRET_KEY]"),
]

# What every match of a pattern holds, by its name in both lists, and is quicker to look for: a pattern,
# or a number of characters without a space among them.  The long s is an s where letters come in either case.
_HELD = {
    "email": "@",
    "phone": r"\d\d\d\d",
    "ssn": r"\d\d\d\d",
    "digits": r"\d\d\d\d",
    "credit_card": r"\d\d\d\d",
    "card": r"\d\d\d\d",
    "api_key": 22,
    "secret_key": 27,
    "bearer_token": "(?i)bearer",
    "aws_access_key": r"A[BCKS][CI]A[A-Z0-9]",
    "aws_secret_key": 40,
    "ip_address": r"\.\d",
    "password_field": "[CcPpSs\u017f](?:[Aa]..[Ww]|[Ww][Dd]|[Ee][Cc][Rr]|[Rr][Ee][Dd])",
    "url_with_creds": "://",
}
#: The same by pattern: a list of one's own may use a name for something else.
HELD = {pattern: _HELD[name] for name, pattern, _ in PATTERNS + CLIENT_PATTERNS}


def _grouped(patterns: list[tuple[str, str, str]]) -> list[tuple[str | int | None, list[tuple[str, str]]]]:
    """What matches hold, and the pairs (pattern, new) in a row that it holds for: without it a text stays as it is."""
    return [(held, [(pattern, new) for _, pattern, new in those]) for held, those in groupby(patterns, lambda p: HELD.get(p[1]))]


def without(patterns: list[tuple[str, str, str]], *names: str) -> list[tuple[str, str, str]]:
    """The list without the patterns of these names, which are allowed through."""
    if unknown := set(names) - {p[0] for p in patterns}:
        raise ValueError(f"no such patterns: {', '.join(sorted(unknown))}")
    return [p for p in patterns if p[0] not in names]


def scrub_text(text: Column, patterns: list[tuple[str, str, str]] = PATTERNS) -> Column:
    """``text`` with every pattern replaced, each in what those before it left; one is tried only where a match can be."""

    def replaced(t: Column, those: list) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, *p), those, t)

    def found(t: Column, held: str | int) -> Column:
        return t.rlike(held) if isinstance(held, str) else F.concat(F.lit(" "), t).rlike(rf"\s\S{{{held}}}")

    def step(t: Column, held: str | int | None, those: list) -> Column:
        # A text is named by the lambda, since it stands there three times.
        return replaced(t, those) if held is None else F.transform(F.array(t), lambda x: F.when(found(x, held), replaced(x, those)).otherwise(x))[0]

    return reduce(lambda t, group: step(t, *group), _grouped(patterns), text)


def counts(text: Column, patterns: list[tuple[str, str, str]] = PATTERNS) -> Column:
    """How often each pattern is found, by name, when those before it have been replaced."""
    out = []
    for name, pattern, new in patterns:
        out += [F.lit(name), F.regexp_count(text, F.lit(pattern)).cast("long")]
        text = F.regexp_replace(text, pattern, new)
    return F.create_map(*out)


def _strings(kind: T.DataType) -> bool:
    """Whether a value of the type holds strings that are scrubbed."""
    if isinstance(kind, T.StructType):
        return any(_strings(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _strings(kind.valueType)
    return isinstance(kind, T.StringType)


def _walk(value: Column, kind: T.DataType, patterns: list) -> Column:
    if not _strings(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, patterns))
    if isinstance(kind, T.MapType):  # keys are names
        return F.transform_values(value, lambda _, x: _walk(x, kind.valueType, patterns))
    if isinstance(kind, T.StructType):
        inner = F.struct(*(_walk(value[f.name], f.dataType, patterns).alias(f.name) for f in kind))
        return F.when(value.isNotNull(), inner)
    return scrub_text(value, patterns)


def _json_walker(patterns: list):
    compiled = [(re.compile(held) if isinstance(held, str) else held, [(re.compile(pattern), new) for pattern, new in those]) for held, those in _grouped(patterns)]

    def text(value: str) -> str:
        longest = None
        for held, those in compiled:
            if isinstance(held, int):
                if longest is None:
                    longest = max(map(len, value.split()), default=0)
                able = longest >= held
            else:
                able = held is None or held.search(value)
            for pattern, new in those if able else ():
                value, n = pattern.subn(lambda _: new, value)
                longest = None if n else longest
        return value

    def walk(value):
        """Iterative, since a document may be nested deeper than Python's stack."""
        root = [value]
        todo = [root]
        while todo:
            inner = todo.pop()
            for key, x in inner.items() if isinstance(inner, dict) else enumerate(inner):
                if isinstance(x, str):
                    inner[key] = text(x)
                elif isinstance(x, (dict, list)):
                    todo.append(x)
        return root[0]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            try:
                parsed = json.loads(value)
            except (ValueError, RecursionError):
                return text(value)  # no JSON: the text as a whole
            return json.dumps(walk(parsed), ensure_ascii=False, separators=(",", ":"))

        return values.map(one, na_action="ignore")

    return run


def scrub(rows: DataFrame, json_columns: list[str] = (), keep: list[str] = (), patterns: list[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """``rows`` with every string value scrubbed but those of the columns in ``keep``.

    Fields of structs, items of arrays and values of maps are walked, whatever their depth; names and keys stay.
    ``json_columns`` are string columns that hold JSON: their strings are scrubbed one by one and the rest
    stays; a text that is no JSON is scrubbed as a whole.  Nulls stay null.
    """
    walker = _json_walker(patterns) if json_columns else None
    out = {}
    for field in rows.schema:
        if field.name in json_columns:
            out[field.name] = walker(F.col(f"`{field.name}`"))
        elif field.name not in keep and _strings(field.dataType):
            out[field.name] = _walk(F.col(f"`{field.name}`"), field.dataType, patterns)
    return rows.withColumns(out) if out else rows
