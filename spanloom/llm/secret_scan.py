"""Secret scan with multipart credential linking.

Strong findings (fixed kinds: assignments, access keys, long hex strings) are always reported.
Weak candidates, an account identifier, a bare key-like string or an endpoint, are reported only
where complementary parts stand near: within a scope (a block of lines without an empty line between
them), every part opens an interval of ``REACH`` code points to both sides, and a weak part is joined
with the parts of other roles whose spans meet its interval.  Identifiers and bare keys need each
other or a strong part of the other role; endpoints need a secret.  The join is a sweep over sorted
spans, one lookup for each part and role, so a document with many parts stays linear.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import words as W
from spanloom.session import small_batches

#: Code points on either side within which parts of one credential are linked.
REACH = 300
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "key": "secret", "endpoint": "endpoint"}
#: What a weak part needs near it, any of these roles.
NEEDS = {"id": ("secret",), "key": ("id",), "endpoint": ("secret",)}

# Fixed values.
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ID = re.compile(
    r"""(?i:client_?id|access_?key_?id|account_?id|app_?id|user_?name|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""",
    re.ASCII,
)
_ID_WORDS = ("_id", "clientid", "keyid", "accountid", "appid", "tenantid", "username", "user_name")
_URL = re.compile(r"https?://[^\s\"'<>]+")
_HOST, _NAME, _FIRST, _LETTER = ".amazonaws.com", re.compile(r"[a-z0-9.-]+"), re.compile(r"\b[a-z0-9]", re.ASCII), re.compile(r"\w", re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", re.ASCII)
_GAP = re.compile(r"\n[\x20\t\r]*\n")


def _random_looking(text: str) -> bool:
    """Mixed character classes and at least 3.5 bits a character."""
    if not (re.search("[a-z]", text) and re.search("[A-Z]", text) and re.search("[0-9]", text)):
        return False
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) >= 3.5


def strong(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the fixed kinds, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append((m.start(), m.end(), "assign", m.start(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                out.append((m.start(), m.end(), "access", m.start()))
    out += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _hosts(text: str) -> list[tuple[int, int]]:
    """Names that end in ``_HOST`` at a word's end; a run of a name's characters is read once."""
    out = []
    for run in _NAME.finditer(text) if _HOST in text else ():
        start, end = run.span()
        at = text.rfind(_HOST, start, end)
        while at >= 0 and _LETTER.match(text, at + len(_HOST)):
            at = text.rfind(_HOST, start, at + len(_HOST) - 1)
        first = _FIRST.search(text, start, at) if at > start else None
        if first:
            out.append((first.start(), at + len(_HOST)))
    return out


def weak(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Candidates that count only in company; those that overlap a strong span are left out."""
    low = text.lower()
    ids = [(m.start(), m.end(), "id", m.start(1)) for m in _ID.finditer(text)] if any(w in low for w in _ID_WORDS) else []
    places = [m.span() for m in _URL.finditer(text)] if "http" in low else []
    points = [(a, b, "endpoint", a) for a, b in places + _hosts(text)]
    keys = []
    if ids or any(s[2] == "access" for s in base):
        keys = [(m.start(), m.end(), "key", m.start()) for m in _KEY.finditer(text) if _random_looking(m[0])]
    out: list[tuple[int, int, str, int]] = []
    taken = sorted((s[0], s[1]) for s in base)
    reach, far = [], -1  # largest end so far: strong spans of different kinds may overlap
    for a, b in taken:
        far = max(far, b)
        reach.append(far)
    for s in sorted(ids + keys + points, key=lambda s: (s[0], KINDS.index(s[2]))):
        k = bisect.bisect_left(taken, (s[1],))
        if not (k and reach[k - 1] > s[0]) and not (out and out[-1][1] > s[0]):
            out.append(s)
    return out


def link(text: str) -> tuple[list, list]:
    """Strong spans, and the weak ones that complementary parts confirm."""
    base = strong(text)
    loose = weak(text, base)
    if not loose:
        return base, []
    gaps = [m.start() for m in _GAP.finditer(text)]
    scope = lambda s: bisect.bisect_left(gaps, s[0])
    parts: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for s in sorted(base + loose):
        own = parts.setdefault((scope(s), ROLES[s[2]]), [])
        own.append((s[0], max(s[1], own[-1][1] if own else 0)))

    def near(s, role) -> bool:
        own = parts.get((scope(s), role), [])
        k = bisect.bisect_left(own, (s[1] + REACH + 1,))
        return k > 0 and own[k - 1][1] >= s[0] - REACH

    return base, [s for s in loose if any(near(s, role) for role in NEEDS[s[2]])]


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and a digest of the strong spans, and all spans.

    Null counts as empty; an empty text has no spans; repeated rows give repeated results; other
    columns are not read.  Offsets are code points, ends exclusive.
    """

    def run(batches):
        for batch in W.pieces(batches, text):
            rows = []
            for t in _texts(batch, text):
                base, linked = link(t)
                n = Counter(s[2] for s in base)
                every = sorted(base + linked, key=lambda s: (s[0], KINDS.index(s[2])))
                sha = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], sha, _joined(every)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the value of every reported span replaced; no row goes, null stays null.

    ``n_chars`` is counted again where a text changed.
    """
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in W.pieces(batches, text):
            texts = batch.column(text).to_pylist()
            changed = {}
            for i, t in enumerate(texts):
                base, linked = link(t or "")
                if not base and not linked:
                    continue
                out, at = [], 0
                for a, b in sorted((s[3], s[1]) for s in base + linked):
                    if a >= at:
                        out += [t[at:a], mark]
                    at = max(at, b)
                texts[i] = changed[i] = "".join([*out, t[at:]])
            columns = {n: batch.column(n) for n in names} | {text: pa.array(texts, batch.column(text).type)}
            if changed and n_chars in names:
                counts = batch.column(n_chars).to_pylist()
                for i, t in changed.items():
                    counts[i] = len(t)
                columns[n_chars] = pa.array(counts, batch.column(n_chars).type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)
