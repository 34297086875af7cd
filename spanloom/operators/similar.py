"""Pairs of word sets that are alike by Jaccard similarity, all of them and no others.

Words are dealt to parts of some dozens by their codes: two sets so alike are so alike in one part at least.  In a part
words are ordered by how rarely they occur, so that the parts have one of their first words in common.  They meet
on those with their sizes, places and parity sketches of the part; what these rule out goes no further, so only pairs
that are nearly alike are shuffled and compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of which counts are sent to all tasks, the most frequent; a word beyond them ranks as rare.
KNOWN = 1_000_000
#: Words of a part at least, twice as many at most; a sketch of 64 bits tells so many apart.
PART = 32
#: Sets that meet on one word in one task, about; where more have it, blocks of so many meet in pairs.
BLOCK = 16_384
#: Rows that are compared at once, if one word has no more.
ROWS = 65_536
#: What a bound may miss by floating point.
SLACK = 1e-9


def words(text: Column) -> Column:
    """Codes of the different words of three letters or more; none of a null."""
    plain = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    codes = F.transform(F.filter(plain, lambda w: F.length(w) >= 3), lambda w: F.xxhash64(w))
    return F.coalesce(F.array_distinct(codes), F.array().cast("array<long>"))


def code(*columns: Column) -> Column:
    """128 bits that stand for equal values."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(*columns, F.lit(1)).alias("b"))


def counts(*sets: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Codes of words that occur more than once and how often, sorted by code; whether these are all such words."""
    said = sets[0].select(F.explode("w").alias("word"))
    for other in sets[1:]:
        said = said.union(other.select(F.explode("w")))
    often = said.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(KNOWN).toArrow().sort_by("word")
    return often.column("word").to_numpy(), often.column("n").to_numpy(), often.num_rows < KNOWN


def _heads(sets: DataFrame, often: tuple, least: float, side: int = 0) -> DataFrame:
    """(g, key, id, x, sketch): the rarest words of the parts of the sets (g, id, w), as keys, with the part's sketch.

    ``x`` holds the part's size, the word's place in it and four marks.  A set is cut as its own size says, and as
    the sizes say that a larger set so alike may have; of two sets the larger one's own cut counts.
    """
    sent = sets.sparkSession.sparkContext.broadcast(often)
    fields = [(c, pa.int64()) for c in ("g", "key", "id", "x", "sketch")]

    def mixed(x: np.ndarray) -> np.ndarray:
        """Hashes of unsigned longs."""
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def level_of(size: np.ndarray) -> np.ndarray:
        """The power of two by which sets of such sizes are cut into parts."""
        return np.frexp(np.maximum(size / PART, 1.0))[1] - 1

    def cut(g, ids, row, word, n, there, whole, level, own):
        part = ((word.view(np.uint64) >> np.uint64(32)) & ((np.uint64(1) << level[row].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        order = np.lexsort((word, n, part, row))
        row, part, word, n, there = (v[order] for v in (row, part, word, n, there))
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[start, len(row)])
        sketch = np.bitwise_xor.reduceat(np.uint64(1) << (word.view(np.uint64) & np.uint64(63)), start)
        segment = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(row)) - start[segment]
        first = size - np.ceil(size * least - SLACK).astype(np.int64) + 1
        # A word of one set alone takes its place but meets nothing.
        keep = np.flatnonzero((at < first[segment]) & (there | (not whole)))
        # Where a word may bring too many sets together, each goes to all pairs of blocks that its own is in.
        blocks = -(-n[keep] // BLOCK)
        other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        keep, blocks = np.repeat(keep, blocks), np.repeat(blocks, blocks)
        row, segment = row[keep], segment[keep]
        block = (mixed(ids[row].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(block, other), np.maximum(block, other)
        key = mixed(word[keep].view(np.uint64) ^ mixed((level[row] + (low << 8) + (high << 36)).astype(np.uint64)))
        marks = side + 2 * own[row] + 4 * (low == high) + 8 * (block == high)
        return g[row], key.view(np.int64), ids[row], marks + (at[keep] << 4) + (size[segment] << 32), sketch.view(np.int64)[segment]

    def run(batches):
        known, times, whole = sent.value
        for batch in batches:
            # Some hundred sets at once, so that a task's memory does not depend on theirs.
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                lists = some.column("w")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                word = lists.flatten().to_numpy(zero_copy_only=False)
                g, ids = (some.column(c).to_numpy(zero_copy_only=False) for c in ("g", "id"))
                row = np.repeat(np.arange(len(size)), size)
                place = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
                there = known[place] == word if len(known) else np.zeros(len(word), bool)
                n = np.where(there, times[place], 1) if len(known) else np.ones(len(word), np.int64)
                level, last = level_of(size), level_of(np.floor(size / least + SLACK))
                for up in range(int((last - level).max(initial=0)) + 1):
                    mine = (level + up <= last)[row]
                    if mine.any():
                        found = cut(g, ids, row[mine], word[mine], n[mine], there[mine], whole, level + up, np.full(len(size), up == 0))
                        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(found, fields, strict=True)], names=[f for f, _ in fields])

    return sets.select("g", "id", "w").mapInArrow(run, ", ".join(f"{c} long" for c, _ in fields))


def near(left: DataFrame, right: DataFrame, least: float, both: bool = False, most: int = 0, often: tuple | None = None, few: bool = False) -> DataFrame:
    """(g, a, b, more): pairs of (g, id, w) of one group whose sets may have a similarity of ``least``; no such pair is missing.

    With ``both`` the sides are one table and each pair is given once, the smaller id first.  With ``most`` a has the
    smaller id too, and a set b that meets more than so many on one word is given those with the smallest ids; ``more`` is
    true of the last of these, and every pair of b with an a up to the smallest such one is there.  ``often`` are the
    :func:`counts` of all sets, ``few`` says that right has some thousand only.
    """
    often = often or (counts(left) if both else counts(left, right))
    heads = _heads(left, often, least)
    if not both:
        others = _heads(right, often, least, 1)
        if few:
            heads = heads.join(F.broadcast(others.select("g", "key").distinct()), ["g", "key"], "left_semi")
        heads = heads.union(others)
    columns, ratio = ("g", "key", "id", "x", "sketch"), least / (1 + least)
    earlier, limit = both or most > 0, most or np.iinfo(np.int64).max

    def meeting(g, key, ids, x, sketch):
        """(g, a, b, more) of the pairs on equal keys that sizes, places and sketches let pass.

        Of each b the first ``limit`` a; ``more`` says at the last of them that others may follow.
        """
        here = np.arange(len(g))
        new = np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])]
        start = np.maximum.accumulate(np.where(new, here, 0))
        side, own, alone, block, at, size = x & 1, x & 2, x & 4, x & 8, (x >> 4) & 0xFFFFFFF, (x >> 32).astype(np.int32)
        if both:
            end = here
        else:
            bucket = np.cumsum(new) - 1
            end = start + np.bincount(bucket, weights=side == 0).astype(np.int64)[bucket]
        # The other part's size at most: what follows here must hold all that is common.
        cap = np.floor((size - at + SLACK) / ratio).astype(np.int32) - size
        found, out = np.zeros(len(g), np.int64), []
        b = here[(start < end) & (both | (side == 1))]
        while len(b):
            a = start[b]
            fits = np.flatnonzero((size[a] <= cap[b]) & (size[b] <= cap[a]))
            p, q = a[fits], b[fits]
            ok = ((own[p] | own[q]) > 0) & ((alone[q] > 0) | (block[p] != block[q]))
            if earlier:
                ok &= ids[p] < ids[q]
            p, q = p[ok], q[ok]
            total = size[p] + size[q]
            near = np.bitwise_count((sketch[p] ^ sketch[q]).view(np.uint64)) <= total - 2 * np.ceil(total * ratio - SLACK)
            p, q = p[near], q[near]
            found[q] += 1
            # Places in start move on with what each b has been compared with.
            start[b] += 1
            if len(p):
                out.append((g[p], ids[p], ids[q], (found[q] == limit) & (start[q] < end[q])))
            b = b[(start[b] < end[b]) & (found[b] < limit)]
            if out and (not len(b) or sum(len(v[0]) for v in out) >= ROWS):
                yield [np.concatenate(v) for v in zip(*out, strict=True)]
                out = []

    def compared(rows):
        for pairs in meeting(*rows) if len(rows[0]) else ():
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs], names=["g", "a", "b", "more"])

    def run(batches):
        held: list = []
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            if sum(len(h[0]) for h in held) < ROWS:
                continue
            rows = [np.concatenate(v) for v in zip(*held, strict=True)]
            # The last word's sets may go on in the next batch.
            done = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
            yield from compared([v[:done] for v in rows])
            held = [[v[done:] for v in rows]]
        if held:
            yield from compared([np.concatenate(v) for v in zip(*held, strict=True)])

    dealt = heads.repartition("g", "key").sortWithinPartitions("g", "key", F.col("x").bitwiseAND(1), "id")
    return dealt.mapInArrow(run, "g long, a long, b long, more boolean").groupBy("g", "a", "b").agg(F.bool_or("more").alias("more"))


def share(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 of two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))
