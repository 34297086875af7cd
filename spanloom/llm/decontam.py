"""Benchmark decontamination with an FM-index over each training shard.

Every shard (a run of documents of bounded size inside a task) is turned into a sequence of
symbols, one per word.  Words that no benchmark item uses cannot be part of a match, so they only
separate runs; runs shorter than the shortest test phrase go too.  Over what is left the shard gets
a suffix array, its Burrows-Wheeler transform held as a wavelet matrix, and suffix positions sampled
at every eighth place and at each run's start.  All test phrases are searched backwards together,
occurrences are located by walking to the next sampled row, and the words they cover are merged
into removal spans.

The test phrases are read in blocks of bounded size (``BLOCK_BYTES`` of text); each block is one pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.session import Workspace, small_batches

#: Words in a test phrase; an item with fewer words is one phrase.
WINDOW = 10
#: Text of test items sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Distance of sampled suffix positions.
SAMPLE = 8


class Phrases:
    """Distinct test phrases over their own vocabulary, and the items that have each, all in arrays.

    Phrase ``p`` has ``lengths[p]`` symbols of ``symbols[p]``; its items are ``names[owner[edges[p] : edges[p + 1]]]``.
    """

    def __init__(self, item_ids: list, texts: list, window: int = WINDOW):
        found = W.split(pa.array(texts, pa.large_string()), W.ALPHANUMERIC)
        self.vocabulary, symbols = np.unique(found.hash, return_inverse=True)
        symbols = np.r_[symbols.astype(np.int32) + 1, np.zeros(window, np.int32)]
        self.names, name = np.unique(np.array([str(i) for i in item_ids], str), return_inverse=True)
        n = found.per_doc
        count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        first = found.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.minimum(n[item], window)
        rows = np.zeros((len(item), window), np.int32)
        for k in range(window):
            rows[:, k] = np.where(k < lengths, symbols[first + k], 0)
        packed = rows.view(np.dtype((np.void, rows.dtype.itemsize * window))).reshape(-1)
        _, at, which = np.unique(packed, return_index=True, return_inverse=True)
        self.symbols, self.lengths = rows[at], lengths[at]
        pairs = np.unique(which.astype(np.int64) * max(len(self.names), 1) + name[item])
        self.owner = (pairs % max(len(self.names), 1)).astype(np.int32)
        self.edges = np.searchsorted(pairs // max(len(self.names), 1), np.arange(len(at) + 1))
        self.shortest = int(self.lengths.min()) if len(at) else 0

    def items(self, row: np.ndarray, phrase: np.ndarray, n: int) -> pa.ListArray:
        """For each of n rows the names of the items that its phrases belong to, sorted."""
        many = self.edges[phrase + 1] - self.edges[phrase]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.edges[phrase], many)
        pairs = np.unique(np.repeat(row, many) * max(len(self.names), 1) + self.owner[at])
        names = pa.array(self.names[pairs % max(len(self.names), 1)].tolist(), pa.string())
        edges = np.searchsorted(pairs // max(len(self.names), 1), np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` by prefix doubling; only ties are sorted again.

    Symbols under 1 end a run and must be distinct, so a tie never reaches past one.
    """
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
    rank = np.empty(len(text), np.int64)
    rank[order] = head
    tied = ~(new & np.r_[new[1:], True])
    slots = np.flatnonzero(tied)
    step = 1
    while len(slots):
        at = order[slots]
        key = rank[at] * len(text) + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = head
        slots = slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of small integers, answered for many places at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.shifts = list(range(max(int(top).bit_length(), 1) - 1, -1, -1))
        self.ones, self.zeros = [], []
        for shift in self.shifts:
            bits = (values >> shift) & 1
            counts = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bits, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(values) - int(counts[-1]))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(place)
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            bit = (symbol >> shift) & 1 == 1
            a, b = ones[place], ones[low]
            place = np.where(bit, zeros + a, place - a)
            low = np.where(bit, zeros + b, low - b)
        return place - low

    def access(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a = ones[place]
            bit = ones[place + 1] - a
            out = out * 2 + bit
            place = np.where(bit == 1, zeros + a, place - a)
        return out


class FMIndex:
    """Backward search and location in one shard's symbols; symbols under 1 end a run."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        last = np.maximum(text[order - 1], 0)
        self.size = len(text)
        self.tree = WaveletMatrix(last, top)
        counts = np.bincount(np.maximum(text, 0), minlength=top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        starts = np.r_[True, text[:-1] < 1]
        self.sampled = (order % SAMPLE == 0) | starts[order]
        self.position = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that occur, and the suffix rows [low, high) of each."""
        alive = np.arange(len(phrases.lengths))
        low = np.zeros(len(alive), np.int64)
        high = np.full(len(alive), self.size, np.int64)
        for step in range(phrases.symbols.shape[1]):
            going = phrases.lengths[alive] > step
            at = np.flatnonzero(going)
            if not len(at):
                break
            symbol = phrases.symbols[alive[at], phrases.lengths[alive[at]] - 1 - step]
            low[at] = self.before[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.tree.rank(symbol, high[at])
            left = high > low
            alive, low, high = alive[left], low[left], high[left]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to the nearest sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            symbol = self.tree.access(rows[going])
            rows[going] = self.before[symbol] + self.tree.rank(symbol, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.position[self.sample_rank[rows]] + steps


def occurrences(found: W.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and number of the phrase, for each place where a phrase stands."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(found.hash) or not phrases.shortest:
        return none
    spot = np.minimum(np.searchsorted(phrases.vocabulary, found.hash), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[spot] == found.hash, spot + 1, 0)
    # Runs of known words inside one document.
    opens = (symbol > 0) & np.r_[True, (symbol[:-1] == 0) | (found.doc[1:] != found.doc[:-1])]
    closes = (symbol > 0) & np.r_[(symbol[1:] == 0) | (found.doc[1:] != found.doc[:-1]), True]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    kept = b - a >= phrases.shortest
    a, b = a[kept], b[kept]
    if not len(a):
        return none
    sizes = b - a + 1  # and the separator
    ends = np.cumsum(sizes)
    word = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(a, sizes)
    text = symbol[np.minimum(word, len(symbol) - 1)]
    text[ends - 1] = -np.arange(len(ends))  # each separator is a symbol of its own
    index = FMIndex(text, len(phrases.vocabulary))
    phrase, low, high = index.search(phrases)
    many = high - low
    if not len(many):
        return none
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return word[index.locate(rows)], np.repeat(phrase, many)


def covered(found: W.Words, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each word lies inside an occurrence."""
    change = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _spans(found: W.Words, hit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first byte, end byte, first word and end word of each merged run of hit words, in its row."""
    follows = np.zeros(len(hit), bool)
    follows[1:] = hit[1:] & hit[:-1] & (found.doc[1:] == found.doc[:-1])
    leads = np.zeros(len(hit), bool)
    leads[:-1] = follows[1:]
    first, last = np.flatnonzero(hit & ~follows), np.flatnonzero(hit & ~leads)
    row = found.doc[first]
    return (
        row,
        found.start[first] - found.offsets[row],
        found.end[last] - found.offsets[row],
        first - found.first[row],
        last + 1 - found.first[row],
    )


SPAN = ["start", "end", "first_word", "end_word"]
REPORT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long,first_word:long,end_word:long>>>"


def _report_column(n_words, items, row, *spans) -> pa.StructArray:
    edges = np.searchsorted(row, np.arange(len(items) + 1)).astype(np.int32)
    n_hit = np.zeros(len(items), np.int64)
    np.add.at(n_hit, row, spans[3] - spans[2])
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words, pa.int64()),
            pa.array(n_hit),
            items if isinstance(items, pa.Array) else pa.array(items, pa.list_(pa.string())),
            pa.ListArray.from_arrays(
                pa.array(edges), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], SPAN)
            ),
        ],
        ["n_words", "n_hit", "items", "spans"],
    )


def _scan(text: str, block, name: str):
    """For mapInArrow: the input's columns and one of the form REPORT; spans are in bytes."""
    kept: dict[str, Phrases] = {}

    def run(batches):
        if "phrases" not in kept:
            kept["phrases"] = Phrases(*block.value)
        phrases = kept["phrases"]
        for batch in W.pieces(batches, text):
            found = W.split(batch.column(text), W.ALPHANUMERIC)
            at, phrase = occurrences(found, phrases)
            hit = covered(found, at, phrases.lengths[phrase])
            pair = np.unique(found.doc[at] * (len(phrases.lengths) + 1) + phrase)
            items = phrases.items(pair // (len(phrases.lengths) + 1), pair % (len(phrases.lengths) + 1), batch.num_rows)
            column = _report_column(found.per_doc, items, *_spans(found, hit))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return run


def _merge(names: list[str], reports: list[str]):
    """For mapInArrow: one report, the first, from those of several blocks of test items."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(r).to_pylist() for r in reports]
            items, row, spans = [], [], []
            for i, own in enumerate(zip(*columns, strict=True)):
                items.append(sorted({x for r in own for x in r["items"]}))
                last = None
                for span in sorted([s[k] for k in SPAN] for r in own for s in r["spans"]):
                    if last and span[2] <= last[3]:
                        if span[3] > last[3]:
                            last[1], last[3] = span[1], span[3]
                    else:
                        spans.append(last := span)
                        row.append(i)
            parts = np.array(spans, np.int64).reshape(-1, 4).T
            column = _report_column([r["n_words"] for r in columns[0]], items, np.array(row, np.int64), *parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, reports[0]])

    return run


def _phrase_blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """Broadcasts of the test items, of at most about BLOCK_BYTES each; the driver holds one at a time."""
    session = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("i is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    if n > 1:  # read once for each block
        items = Workspace(session, "decontam").save(items, "items")
    blocks = []
    for k in range(n):
        rows = (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items).toArrow()
        blocks.append(session.sparkContext.broadcast((rows.column("i").to_pylist(), rows.column("t").to_pylist())))
    return blocks


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    then=None,
    schema=None,
) -> DataFrame:
    """``docs`` with a column ``_report``: words, hit words, items found and merged removal spans.

    A null text has no words and no hits; an empty benchmark or one without words hits nothing;
    repeated items count once under their id; every input row, repeated or not, gives one row.
    Items with a null id are skipped.  Offsets of spans are bytes of the UTF-8 text, end exclusive.
    A column of the input named ``_report`` is replaced.  ``then``, a function for mapInArrow whose output
    has ``schema``, runs in the same pass, so no second Python worker is needed.
    """
    session = docs.sparkSession
    small_batches(session)
    blocks = _phrase_blocks(benchmark, item, item_text)
    docs = docs.drop("_report")
    free = "_report"
    while any(c.startswith(f"{free}_") for c in docs.columns):
        free += "_"
    names = ["_report", *(f"{free}_{k}" for k in range(1, len(blocks)))]
    steps = [_scan(text, b, n) for n, b in zip(names, blocks, strict=True)]
    last = [steps[-1], *([_merge(docs.columns, names)] if len(names) > 1 else []), *([then] if then else [])]

    def end(batches):
        for step in last:
            batches = step(batches)
        return batches

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    out = docs
    for k, step in enumerate(steps[:-1]):
        out = out.mapInArrow(step, ", ".join([*own, *(f"{n} {REPORT}" for n in names[: k + 1])]))
    return out.mapInArrow(end, schema if then else ", ".join([*own, f"_report {REPORT}"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without the passages of test items; each becomes a line break.

    Documents in which nothing but such passages stood are dropped; all others stay, with
    ``n_chars`` counted again where a passage went.  Null and empty texts stay as they are.
    """
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            reports = batch.column("_report").to_pylist()
            keep = []
            for i, report in enumerate(reports):
                if report["spans"]:
                    raw, out, at = texts[i].encode(), [], 0
                    for span in report["spans"]:
                        out += [raw[at : span["start"]], b"\n"]
                        at = span["end"]
                    texts[i] = b"".join([*out, raw[at:]]).decode()
                keep.append(not report["spans"] or bool(W.ALPHANUMERIC[np.frombuffer(texts[i].encode(), np.uint8)].any()))
            columns = {n: batch.column(n) for n in names} | {text: pa.array(texts, pa.string())}
            if n_chars in names:
                old = columns[n_chars].to_pylist()
                new = [len(t) if r["spans"] else o for t, r, o in zip(texts, reports, old, strict=True)]
                columns[n_chars] = pa.array(new, batch.column(n_chars).type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep, pa.bool_()))

    return scan(docs, benchmark, text, then=cut, schema=docs.schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts of words and hit words, and a digest of the items found."""

    def digest(batches):
        for batch in batches:
            report = batch.column("_report")
            items = pc.struct_field(report, "items").to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pc.struct_field(report, "n_words"),
                    "n_hit": pc.struct_field(report, "n_hit"),
                    "n_items": pa.array([len(x) for x in items], pa.int64()),
                    "items_sha256": pa.array(sha, pa.string()),
                    "contaminated": pa.array([bool(x) for x in items], pa.bool_()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return scan(docs.select("doc_id", "text"), benchmark, then=digest, schema=schema)
