"""Repeated passages: MinHash banding over paragraphs, exact verification, removal by components.

A paragraph is a line of at least ``LEAST_WORDS`` words; what has fewer is no passage.  Its shingles
are five consecutive words, lower-cased, without marks.  Paragraphs with the same shingles are one item.  Signatures are cut into
bands of ``ROWS`` hashes, as many as give the wanted recall at the threshold; items that share a band
collide, and colliding items are verified by exact Jaccard similarity on their whole sets, without
making all pairs of a group (see :func:`spanloom.llm.ngram_join.find_links`).  Of each component the
first paragraph, by document and place, stays.

Passages need not be lines: they may run over several short ones or stand inside a longer one.  So
windows of ``LEAST_WORDS`` words are taken as well, across line ends, at content-defined anchors: of any
``SPREAD`` places that follow each other one at least is an anchor, which depends on the words there
alone.  Documents that share ``LEAST_WORDS + SPREAD`` words or more thus share a window word for word.
Windows that two documents have are counted with partial sums; those that overlap in a document become
one passage, and the first document by id keeps it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import selecting
from spanloom.llm import words as W
from spanloom.llm.components import components
from spanloom.llm.ngram_join import find_links, set_codes, shingle_sets, short_sketches
from spanloom.session import Workspace

SHINGLE = 5
PERCENT = 80
LEAST_WORDS = 30
#: Places of which one at least begins a window.
SPREAD = 20
_FACTORS = W.mix(np.arange(71, 71 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
#: Hashes of a band, and the chance with which a pair at the threshold must share one.
ROWS, RECALL = 5, 0.999


def band_count(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands with which a pair at the threshold collides as often as wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


class Paragraphs:
    """The long paragraphs of a column of texts; offsets are bytes of the whole buffer."""

    def __init__(self, texts: pa.Array, least: int = LEAST_WORDS):
        found = W.split(texts, W.ALPHANUMERIC)
        lines = np.unique(np.concatenate([found.offsets[:-1], np.flatnonzero(found.data == 10) + 1]))
        ends = np.r_[lines[1:], len(found.data)]
        ends = ends - ((ends > lines) & (found.data[np.maximum(ends, 1) - 1] == 10) if len(found.data) else 0)
        line = np.searchsorted(lines, found.start, side="right") - 1
        words = np.bincount(line, minlength=len(lines))
        kept = np.flatnonzero(words >= least)
        place = np.full(len(lines), -1)
        place[kept] = np.arange(len(kept))
        own = place[line] >= 0 if len(line) else np.zeros(0, bool)
        self.row = np.searchsorted(found.offsets, lines[kept], side="right") - 1
        first_line = np.searchsorted(lines, found.offsets[:-1])
        self.number = kept - first_line[self.row]
        self.words = words[kept]
        letters = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])  # code points
        base = letters[found.offsets[self.row]]
        self.start, self.end = letters[lines[kept]] - base, letters[ends[kept]] - base
        doc = place[line[own]]
        first = np.searchsorted(doc, np.arange(len(kept) + 1))
        inside = W.Words(found.data, found.offsets, found.start[own], found.end[own], doc, first, found.hash[own])
        self.doc, self.values = shingle_sets(inside, SHINGLE)
        self.size = np.bincount(self.doc, minlength=len(kept))
        self.code = set_codes(self.doc, self.values, len(kept))


def band_keys(p: Paragraphs, chosen: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """(paragraphs, bands): keys of the chosen paragraphs' MinHash bands."""
    own = chosen[p.doc]
    values = p.values[own]
    starts = np.concatenate([[0], np.cumsum(p.size[chosen])])[:-1]
    rng = np.random.default_rng(29)
    factors = rng.integers(0, 1 << 63, (bands * rows, 2), dtype=np.uint64) | np.uint64(1)
    keys = np.zeros((int(chosen.sum()), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(keys), band + 1, np.uint64)
        for a, b in factors[band * rows : (band + 1) * rows]:
            hashed = values * a + b
            hashed ^= hashed >> np.uint64(31)
            key = W.mix(key ^ np.minimum.reduceat(hashed * b, starts))
        keys[:, band] = key
    return keys


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _summaries(least: int):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            p = Paragraphs(batch.column("text"), least)
            sketch = short_sketches(p.doc, p.values, len(p.row))
            numbers = [pa.array(x.astype(np.int64)) for x in (p.number, p.start, p.end, p.words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(p.row)), *numbers, _long(p.code), sketch],
                ["doc_id", "paragraph", "start", "end", "n_words", "item", "sketch"],
            )

    return run


def _keys(least: int, bands: int):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            p = Paragraphs(batch.column("text"), least)
            if not len(p.row):
                continue
            chosen = np.zeros(len(p.row), bool)
            chosen[np.unique(p.code, return_index=True)[1]] = True
            keys = band_keys(p, chosen, bands)
            code, size = np.repeat(p.code[chosen], bands), np.repeat(p.size[chosen].astype(np.int32), bands)
            yield pa.RecordBatch.from_arrays([_long(keys.reshape(-1)), _long(code), pa.array(size)], ["key", "item", "n"])

    return run


def _sets(least: int):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            p = Paragraphs(batch.column("text"), least)
            edges = np.concatenate([[0], np.cumsum(p.size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), _long(p.values))
            yield pa.RecordBatch.from_arrays([_long(p.code), lists], ["item", "shingles"])

    return run


class Windows:
    """Windows of ``least`` words at anchors, over whole texts; offsets are code points of the text."""

    def __init__(self, texts: pa.Array, least: int = LEAST_WORDS):
        found = W.split(texts, W.ALPHANUMERIC)
        n = len(found.hash) - max(least, SHINGLE) + 1
        at = np.zeros(0, np.int64)
        if n > 0:
            inside = found.doc[:n] == found.doc[least - 1 :][:n]
            anchor = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                anchor += found.hash[k : n + k] * _FACTORS[k]
            anchor = W.mix(anchor)
            anchor[~inside] = 0  # runs of places end here: no spread reaches across
            low = _slide(np.minimum, anchor, SPREAD)
            low = np.concatenate([np.zeros(SPREAD - 1, np.uint64), low, np.zeros(SPREAD - 1, np.uint64)])
            at = np.flatnonzero((_slide(np.maximum, low, SPREAD)[:n] == anchor) & inside)
        self.row = found.doc[at]
        code = np.zeros(len(at), np.uint64)
        for k in range(least):
            code = W.mix(code + found.hash[at + k])
        self.code = code
        self.first_word = at - found.first[self.row]
        letters = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
        base = letters[found.offsets[self.row]]
        self.start, self.end = letters[found.start[at]] - base, letters[found.end[at + least - 1]] - base
        breaks = np.concatenate([[0], np.cumsum(found.data == 10)])
        self.paragraph = breaks[found.start[at]] - breaks[found.offsets[self.row]]


def _slide(best, values: np.ndarray, width: int) -> np.ndarray:
    """The best of each ``width`` values that follow each other, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = best(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


def _windows(least: int):
    names = ["first_word", "start", "end", "paragraph"]

    def run(batches):
        for batch in W.pieces(batches, "text"):
            w = Windows(batch.column("text"), least)
            numbers = [pa.array(x.astype(np.int32)) for x in (w.first_word, w.start, w.end, w.paragraph)]
            ids = [batch.column(n).take(pa.array(w.row)) for n in ("doc_id", "copy")]
            yield pa.RecordBatch.from_arrays([_long(w.code), *ids, *numbers], ["window", "doc_id", "copy", *names])

    return run


def _passages(slim: DataFrame, lines: DataFrame, least: int, work: Workspace) -> DataFrame:
    """The rows of kind passage: windows that two documents share, merged where they overlap."""
    kind = slim.schema["doc_id"].dataType.simpleString()
    # Rows without an id are documents by their text.
    named = slim.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("copy"))
    found = named.mapInArrow(_windows(least), f"window long, doc_id {kind}, copy long, first_word int, start int, end int, paragraph int")
    found = work.save(found, "windows")
    document = F.xxhash64("doc_id", "copy")
    shared = found.groupBy("window").agg(F.min(document).alias("lo"), F.max(document).alias("hi")).where("lo <> hi")
    own = work.save(selecting.keep(found, work.save(shared.select("window"), "shared"), "window"), "own")
    work.drop(found)
    place = F.struct("doc_id", "copy", "first_word", "paragraph")
    heads = work.save(own.groupBy("window").agg(F.min(place).alias("head"), F.count("*").alias("n_members")), "heads")
    own = own.join(heads, "window")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("copy") == F.col("head.copy"))
    own = own.select("doc_id", "copy", "first_word", "start", "end", "paragraph", "n_members", "head", (~same).alias("removed"))
    # A window joins the one before where they overlap and the same document keeps both.
    by = Window.partitionBy("doc_id", "copy", "removed", "head.doc_id", "head.copy").orderBy("first_word", "start")
    starts = F.coalesce(F.col("first_word") - F.lag("first_word").over(by) > least, F.lit(True))
    own = own.withColumn("_run", F.sum(starts.cast("int")).over(by))
    merged = own.groupBy("doc_id", "copy", "removed", F.col("head.doc_id").alias("kept_doc_id"), F.col("head.copy").alias("kept_copy"), "_run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        F.min("paragraph").cast("long").alias("paragraph"),
        (F.max("first_word") - F.min("first_word") + least).cast("long").alias("n_words"),
        F.min_by("head.paragraph", "first_word").cast("long").alias("kept_paragraph"),
        F.max("n_members").alias("n_members"),
    )
    whole = lines.select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end"))
    merged = work.save(merged, "merged").join(whole, inside, "left_anti")
    return merged.select(
        "doc_id", F.lit("passage").alias("kind"), "paragraph", "start", "end", "n_words", "kept_doc_id", "kept_paragraph", "n_members", "removed"
    )


def repeated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per passage that occurs again, alike or nearly: where it stands and whether it goes.

    Columns: doc_id, kind (line, or passage for what is no line), paragraph (the number, from 0, of the
    line where it begins), start and end (code points, end exclusive), n_words, kept_doc_id and
    kept_paragraph (the one of its component that stays), n_members, removed.  Passages inside a line
    that is reported are left out.  Null and empty texts have none.  Rows repeated under one id are the
    same document.  Null ids come first in the order.  Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "substring-dedup")
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lines = work.save(_lines(slim, least, percent, work), "lines")
    return lines.unionByName(_passages(slim, lines, least, work))


def _lines(slim: DataFrame, least: int, percent: int, work: Workspace) -> DataFrame:
    """The rows of kind line."""
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(
        _summaries(least), f"doc_id {kind}, paragraph long, start long, end long, n_words long, item long, sketch binary"
    )
    found = work.save(found, "paragraphs")

    def fetch(owners: DataFrame, items: DataFrame) -> DataFrame:
        chosen = selecting.keep(slim, owners.select(F.col("owner").alias("doc_id")).where("doc_id is not null"))
        if not owners.where("owner is null").isEmpty():
            chosen = chosen.union(slim.where("doc_id is null"))
        sets = chosen.select("doc_id", "text").mapInArrow(_sets(least), "item long, shingles array<long>")
        return selecting.keep(sets, items, "item")

    keys = slim.mapInArrow(_keys(least, band_count(percent)), "key long, item long, n int")
    links = find_links(keys, found.select("item", "sketch", F.col("doc_id").alias("owner")), fetch, work, percent)
    groups = components(links, work)
    firsts = found.groupBy("item").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("n"))
    rooted = firsts.join(groups, firsts.item == groups.node, "left").select(
        "item", "first", "n", F.coalesce("component", "item").alias("root")
    )
    rooted = work.save(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("n_members")).where("n_members > 1")
    named = work.save(rooted.join(work.save(heads, "heads"), "root").select("item", "head", "n_members"), "named")
    out = found.drop("sketch").join(named, "item").drop("item")
    return out.select(
        "doc_id",
        F.lit("line").alias("kind"),
        "paragraph",
        "start",
        "end",
        "n_words",
        F.col("head.doc_id").alias("kept_doc_id"),
        F.col("head.paragraph").alias("kept_paragraph"),
        "n_members",
        (~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("paragraph") == F.col("head.paragraph")))).alias("removed"),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without the paragraphs that :func:`repeated` removes; rows and columns stay."""
    gone = repeated(docs, key, text).where("removed").select(F.col("doc_id").alias("_id"), F.struct("start", "end").alias("span"))
    gone = gone.groupBy("_id").agg(F.array_sort(F.collect_set("span")).alias("_gone"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"))
    joined = packed.join(gone, F.col("_key").eqNullSafe(F.col("_id")), "left").select("_row.*", "_gone")
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            texts, gone = batch.column(text).to_pylist(), batch.column("_gone").to_pylist()
            counts = batch.column(n_chars).to_pylist() if n_chars in names else None
            for i, spans in enumerate(gone):
                if spans and texts[i]:
                    out, at = [], 0
                    for span in spans:
                        a, b = span["start"], span["end"]
                        out.append(texts[i][at:a])
                        line = texts[i][b : b + 1] == "\n" and (a == 0 or texts[i][a - 1] == "\n")
                        at = max(at, b + line)  # and a line's end
                    texts[i] = "".join([*out, texts[i][at:]])
                    if counts:
                        counts[i] = len(texts[i])
            columns[text] = pa.array(texts, batch.column(text).type)
            if counts:
                columns[n_chars] = pa.array(counts, batch.column(n_chars).type)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, docs.schema)
