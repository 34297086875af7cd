"""Packing tokenised documents into sequences of one length, as few as possible.

Spark tokenises, counts pieces by length and puts every piece in its place.  Which lengths share a sequence
depends on the counts alone, at most one for each length, so that the driver's part does not grow with the
corpus: a linear program over configurations (multisets of lengths that fit) is solved by multiplicative weights
whose pricing is a knapsack, then rounded down; what is left is dealt by best fit into free places and new sequences.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.words import pieces as slices
from spanloom.session import Workspace

CAPACITY = 2048
#: How much a configuration's use lowers the price of a length whose demand it meets in full.
LEARNING = 2.0
#: Share of the tightest length's open demand that one step meets.
STEP = 0.15
#: Configurations of one pricing are taken if their value is within this many tokens of the best; so many pieces are tried for them.
NEAR, TRIES = 0.5, 256
#: The program ends when this share of the tokens is left; best fit deals them out, small pieces among them.
REST = 0.02
_RANKS = np.int64(1) << 48


@dataclass(frozen=True)
class Vocabulary:
    """One byte-level vocabulary in two forms: the file of the ``tokenizers`` library, and ranks with their pattern.

    Both give the same ids.  Ranks are several times faster; texts with runs of spaces too long for their
    pattern are left to the other.  ``special`` strings in a text become their ids, as they do by default.
    """

    json: str
    ranks: str
    pattern: str
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=2)
def _by_ranks(vocabulary: Vocabulary):
    import tiktoken

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))


@lru_cache(maxsize=2)
def _by_json(vocabulary: Vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.json)


def token_ids(vocabulary: Vocabulary, text: str) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    try:
        return _by_ranks(vocabulary).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:  # the pattern's stack does not hold a very long run of spaces
        return np.array(_by_json(vocabulary).encode(text, add_special_tokens=False).ids, "<u4")


def cut(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, place): pieces, numbered within their task and length."""
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("place", T.LongType())]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(*k) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            row, number, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                ids = np.append(token_ids(vocabulary, value.as_py() or ""), np.uint32(0)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), number.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            lengths = np.array(length, np.int64)
            place = np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            found, first, many = np.unique(lengths[order], return_index=True, return_counts=True)
            place[order] = np.arange(len(lengths)) - np.repeat(first - seen[found], many)
            seen[found] += many
            columns = [batch.column("key").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())]
            columns += [pa.array(np.full(len(lengths), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def knapsack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By room: the most value that fits and its last piece, 0 for none; of equals the longest; ``values`` by length, from 0."""
    capacity = len(values) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    falling = np.ascontiguousarray(values[::-1])
    for c in range(1, capacity + 1):
        gain = best[:c] + falling[capacity - c : capacity]  # of a piece of c, c - 1, ... 1 in what is left
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], c - k
        else:
            best[c] = best[c - 1]
    return best, last


def configurations(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(lengths, multiplicities, value) of the best configuration and of near best ones that share no length with it or each other."""
    capacity = len(values) - 1
    best, last = knapsack(values)
    used = np.zeros(capacity + 1, bool)
    gain = np.where(values > 0, values + best[::-1], 0.0)  # with one piece of the length for certain
    order = np.argsort(-gain, kind="stable")[:TRIES]
    for first in order[gain[order] >= best[-1] - NEAR].tolist():
        taken, c = [first], capacity - first
        while c > 0 and not used[taken[-1]]:
            if last[c]:
                taken.append(int(last[c]))
            c -= int(last[c]) or 1
        if not used[taken].any():
            lengths, many = np.unique(taken, return_counts=True)
            used[lengths] = True
            yield lengths, many, float(best[-1])


@dataclass
class Plan:
    """Configurations: how many sequences hold which lengths how often, in the order in which they lie there.

    ``bound`` says how many sequences any packing of the counted pieces needs at least.
    """

    copies: list[int] = field(default_factory=list)
    holds: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(self.copies)

    def entries(self) -> dict[str, np.ndarray]:
        """For each length, runs of its pieces: the first one's rank, the configuration's first sequence and copies, the offset."""
        rows, taken, first = [], {}, 0
        for copies, holds in zip(self.copies, self.holds):
            offset = 0
            for length, many in holds:
                rank = taken.get(length, 0)
                rows.append((length * int(_RANKS) + rank, first, copies, offset))
                taken[length] = rank + copies * many
                offset += length * many
            first += copies
        columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return dict(zip(("run", "first", "copies", "offset"), columns))


def fractional(counts: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """Configurations with the share of sequences that each gets, and the least number of sequences.

    Multiplicative weights for the covering program: prices start in proportion to length; each round the
    knapsack's best configurations meet part of the demand of their lengths and lower their prices; a
    length whose demand is met drops out.  Any round's prices give a lower bound by duality.
    """
    lengths = np.arange(capacity + 1)
    left, weight = counts.astype(np.float64), np.ones(capacity + 1)
    uses: dict[tuple, float] = {}
    bound, volume = 0.0, float(counts @ lengths)
    while left @ lengths > REST * volume:
        values = np.where(left >= 1, lengths * (1 + weight / capacity), 0.0)
        if not values.any():
            break
        for taken, many, worth in configurations(values):
            bound = max(bound, float(counts @ values) / worth)
            room = float((left[taken] / many).min())
            step = room if room < 2 else max(1.0, STEP * room)
            name = tuple(zip(taken.tolist(), many.tolist()))
            uses[name] = uses.get(name, 0.0) + step
            left[taken] -= step * many
            weight[taken] *= np.exp(-LEARNING * step * many / counts[taken])
    return uses, bound


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Which lengths share a sequence, for so many pieces of each length up to ``capacity``."""
    open_ = np.zeros(capacity + 1, np.int64)
    for length, many in counts.items():
        open_[length] = many
    if not open_.any():
        return Plan()
    uses, bound = fractional(open_, capacity)
    groups: dict[int, list[tuple[tuple, int]]] = {}  # by free tokens
    for holds, share in uses.items():
        copies = min([int(share + 1e-9), *(int(open_[length]) // many for length, many in holds)])
        if copies > 0:
            for length, many in holds:
                open_[length] -= copies * many
            groups.setdefault(capacity - sum(a * b for a, b in holds), []).append((holds, copies))
    free = sorted(groups)
    for length in range(capacity, 0, -1):
        while open_[length]:
            at = bisect_left(free, length)
            if at == len(free):  # new sequences, full of this length as far as it goes
                each = min(capacity // length, int(open_[length]))
                holds, copies, room = ((length, each),), int(open_[length]) // each, capacity - length * each
                open_[length] -= copies * each
            else:
                here = free[at]
                holds, there = groups[here].pop()
                copies = min(there, int(open_[length]))
                if copies < there:
                    groups[here].append((holds, there - copies))
                if not groups[here]:
                    del groups[here], free[at]
                together = dict(holds)
                together[length] = together.get(length, 0) + 1
                holds, room = tuple(together.items()), here - length
                open_[length] -= copies
            if room not in groups:
                groups[room] = []
                insort(free, room)
            groups[room].append((holds, copies))
    out = Plan(bound=bound)
    for room in sorted(groups):
        for holds, copies in groups[room]:
            out.copies.append(copies)
            out.holds.append(holds)
    return out


def pack(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): a row a piece.

    A document is the ids of its text, null counting as empty, and then 0.  One longer than ``capacity``
    is cut into pieces of that length, of which the first may be shorter.  Every row of ``docs`` is packed:
    repeated rows and rows without a key too.  An empty table gives no rows.  Columns other than the two are
    ignored.  A piece of full length is alone in its sequence, whose number is then negative; which of the
    equally long pieces go together follows their order in the table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cuts = work.save(cut(docs, vocabulary, key, text, capacity), "pieces")
    each = work.save(cuts.where(F.col("length") < capacity).groupBy("length", "part").count(), "counts")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan(counts, capacity).entries())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cuts.join(base, ["length", "part"], "left")
    kinds = [("sequence_id", T.LongType()), ("offset", T.LongType())]
    names = [key, "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*(cuts.schema[n] for n in names), *(T.StructField(*k) for k in kinds)])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        for batch in batches:
            length, part, place, base = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "part", "place", "base"))
            sequence = -1 - (part.astype(np.int64) * (1 << 33) + place)
            offset = np.zeros(len(length), np.int64)
            some = np.flatnonzero(length < capacity)
            if len(some):
                rank = length[some] * _RANKS + base[some].astype(np.int64) + place[some]
                at = np.searchsorted(runs["run"], rank, side="right") - 1
                nth = rank - runs["run"][at]
                sequence[some] = runs["first"][at] + nth % runs["copies"][at]
                offset[some] = runs["offset"][at] + nth // runs["copies"][at] * length[some]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(put, schema)
