"""Exact n-gram Jaccard join by parity sketches.

The shingles of a text are hashed into a bit sketch by exclusive or: each toggles one bit, so the
Hamming distance of two sketches is at most the size of the symmetric difference of the two sets.
Within a size band a link (Jaccard of at least ``PERCENT`` in a hundred) allows at most
``(100 - PERCENT) * (a + b) / (100 + PERCENT)`` differing shingles, so of one block more than that
at least one is equal in both sketches: blocks are the join keys.  A block is held as the exclusive
or of a 64-bit code of each of its set bits.

Equal blocks say nothing where they are empty, so a text with an empty block also sends the blocks
of a second partition, and so on; the last partition sends its empty blocks too.  Bands of more than
``CHAINED`` blocks leave that out: all untouched blocks would have to be empty at once, which has a
chance of less than 1e-12.

Texts with the same set are one item.  Each item is first compared with the smallest one that shares
a key with it and whose short sketch (two bits a shingle) is near enough for a link.  Items of a key
that are then still in different components meet again, each with the one whose sketch is nearest.
What is apart even then is compared in all pairs whose sketches leave room for a link, so no link
between components is lost, while a large group of near copies costs a few comparisons for each
member.  A large group is compared in pairs of blocks, by many tasks.  All pairs are verified on the
whole sets of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import selecting
from spanloom.llm import words as W
from spanloom.llm.components import components
from spanloom.session import Workspace

SHINGLE = 4
PERCENT = 85
#: What counts as a near copy where documents are removed.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Ratio of the ends of a size band.
BAND = 1.6
#: Bands of up to so many blocks send further partitions for texts with empty blocks.
CHAINED = 32
SEEDS = 8
#: Words of 64 bits in a short sketch, which rules out pairs before their sets are read, at least; it
#: has about two bits for each shingle.
SKETCH = 8
#: Items that meet in one place at most, about; larger groups are cut into blocks.
MEET = 2048
#: The side of items that meet all others of their place.
BOTH = 2

_FACTORS = W.mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both; a shorter text is one shingle."""
    n = len(found.hash)
    count = found.per_doc
    parts, rows = [], []
    if n >= size:
        mixed = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            mixed += found.hash[k : n - size + 1 + k] * _FACTORS[k]
        whole = found.doc[: n - size + 1] == found.doc[size - 1 :]
        parts.append(mixed[whole])
        rows.append(found.doc[: n - size + 1][whole])
    for length in range(1, size):
        short = np.flatnonzero(count == length)
        if len(short):
            mixed = np.full(len(short), length, np.uint64)
            for k in range(length):
                mixed += found.hash[found.first[short] + k] * _FACTORS[k + size]
            parts.append(mixed)
            rows.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values, doc = W.mix(np.concatenate(parts)), np.concatenate(rows)
    order = np.argsort(values)
    doc = doc[order]
    again = np.argsort(doc.astype(np.uint16) if len(count) < 1 << 16 else doc, kind="stable")
    values, doc = values[order[again]], doc[again]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], values[new]


def set_codes(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A code of each row's whole set; of no meaning for empty ones."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, W.mix(values ^ _FACTORS[40]))
    return W.mix(out)


def short_sketches(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """For each row a parity sketch: each shingle toggles one bit.

    Lengths are powers of two, about two bits a shingle; the exclusive or of a sketch's halves is the
    row's sketch of half the length.
    """
    size = np.bincount(doc, minlength=n)
    length = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(size / 32, 1))).astype(np.int64))
    ends = np.cumsum(length)
    bit = W.mix(values ^ _FACTORS[60])
    word = (bit >> np.uint64(6)).astype(np.int64) & (length[doc] - 1)
    out = np.zeros(int(ends[-1]) if n else 0, np.uint64)
    np.bitwise_xor.at(out, (ends - length)[doc] + word, np.uint64(1) << (bit & np.uint64(63)))
    offsets = pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(out)])


def folded(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length): sketches brought to one length, that of the shortest or less."""
    out = np.zeros((len(column), length), np.uint64)
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, length), axis=0)
    return out


def may_link(sketch_a, n_a, sketch_b, n_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and the distance of short sketches leave room for a link, and that distance
    relative to the sizes; arrays broadcast."""
    distance = np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    near = distance * (100 + percent) <= (100 - percent) * (n_a + n_b)
    return near & (np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b)), distance / (n_a + n_b)


class Bands:
    """Size bands and the number of blocks that each needs."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(int(self.lows[-1] * BAND) + 1)
        highs = [x - 1 for x in self.lows[1:]]
        self.blocks = np.array([(100 - percent) * 2 * high // (100 + percent) + 1 for high in highs])
        self.edges = np.array(self.lows)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def reaches_next(self, sizes: np.ndarray) -> np.ndarray:
        """Whether a set may be linked with one of the next band."""
        return sizes * 100 // self.percent >= self.edges[self.of(sizes) + 1]


def _blocks(doc, values, band, blocks, seed):
    """(row, key, is empty) of all blocks; ``doc`` are places in ``band`` and ``blocks``, sorted."""
    base = np.cumsum(blocks) - blocks
    spread = W.mix(values ^ _FACTORS[41 + seed])
    block = base[doc] + ((spread >> np.uint64(32)) * blocks[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(blocks.sum())
    code = np.zeros(total, np.uint64)
    np.bitwise_xor.at(code, block, W.mix(spread))
    row = np.repeat(np.arange(len(blocks)), blocks)
    inside = np.arange(total) - base[row]
    salt = (band[row].astype(np.uint64) << np.uint64(44)) | (np.uint64(seed) << np.uint64(40)) | inside.astype(np.uint64)
    return row, W.mix(code ^ W.mix(salt)), np.bincount(block, minlength=total) == 0


def block_keys(doc: np.ndarray, values: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all blocks by which each row's set must be found."""
    out_row, out_key = [], []

    def send(rows: np.ndarray, band: np.ndarray) -> None:
        rows, band = rows[bands.blocks[band] > 1], band[bands.blocks[band] > 1]  # one block: equal sets only
        for seed in range(SEEDS):
            if not len(rows):
                return
            place = np.full(len(sizes), -1)
            place[rows] = np.arange(len(rows))
            own = place[doc] >= 0
            blocks = bands.blocks[band]
            row, key, empty = _blocks(place[doc[own]], values[own], band, blocks, seed)
            sent = ~empty if seed < SEEDS - 1 else np.ones(len(key), bool)
            out_row.append(rows[row[sent]])
            out_key.append(key[sent])
            again = (np.bincount(row, empty, minlength=len(rows)) > 0) & (blocks <= CHAINED)
            rows, band = rows[again], band[again]

    full = np.flatnonzero(sizes)
    band = bands.of(sizes[full])
    send(full, band)
    next_too = bands.reaches_next(sizes[full])
    send(full[next_too], band[next_too] + 1)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return (np.concatenate(out_row), np.concatenate(out_key)) if out_row else none


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _summaries(key: str, text: str, size: int):
    def run(batches):
        for batch in W.pieces(batches, text):
            found = W.split(batch.column(text), W.BETWEEN_SPACES)
            doc, values = shingle_sets(found, size)
            sizes = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
            codes = pa.array(set_codes(doc, values, batch.num_rows).view(np.int64), mask=sizes == 0)
            sketch = short_sketches(doc, values, batch.num_rows)
            columns = [batch.column(key), pa.array(sizes), codes, sketch]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "item", "sketch"])

    return run


def _keys(text: str, size: int, percent: int):
    bands = Bands(percent)

    def run(batches):
        for batch in W.pieces(batches, text):
            found = W.split(batch.column(text), W.BETWEEN_SPACES)
            doc, values = shingle_sets(found, size)
            codes = set_codes(doc, values, batch.num_rows)
            sizes = np.bincount(doc, minlength=batch.num_rows)
            # Copies within the batch send their keys once.
            first = np.zeros(batch.num_rows, bool)
            first[np.unique(codes, return_index=True)[1]] = True
            own = first[doc]
            row, keys = block_keys(doc[own], values[own], np.where(first, sizes, 0), bands)
            for i in range(0, len(row), 1 << 18):
                r = row[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [_long(keys[i : i + (1 << 18)]), _long(codes[r]), pa.array(sizes[r].astype(np.int32))],
                    ["key", "item", "n"],
                )

    return run


def _collisions(batches):
    """Of rows sorted by key and item: those of keys that several items share, with the key's first item."""
    last = None  # the first row of the key at hand: (key, item, n, whether it was sent)
    for batch in batches:
        key, item, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_key[0] = last is None or key[0] != last[0]
        head = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
        inside = head >= 0
        head_item = np.where(inside, item[head], last[1] if last else 0)
        head_n = np.where(inside, n[head], last[2] if last else 0)
        repeated = np.zeros(len(key), bool)
        repeated[1:] = (item[1:] == item[:-1]) & ~new_key[1:]
        other = (item != head_item) & ~repeated
        shared = np.zeros(len(key), bool)
        shared[head[other & inside]] = True  # first rows of keys that have another item here
        carry = bool(len(other) and last and not last[3] and (other & ~inside).any())
        sent = other | shared
        cols = [key[sent], item[sent], n[sent], head_item[sent], head_n[sent]]
        if carry:
            cols = [np.r_[x, c].astype(c.dtype) for x, c in zip((last[0], last[1], last[2], last[1], last[2]), cols, strict=True)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "item", "n", "pivot", "pivot_n"])
        if head[-1] >= 0:
            k = head[-1]
            last = (key[k], item[k], n[k], bool(shared[k]))
        elif carry:
            last = (*last[:3], True)


def _split_groups(rows: DataFrame) -> DataFrame:
    """Large groups (key, item, n, c, size) as meetings of blocks of at most about ``MEET`` items.

    The largest component of a key is cut into blocks that each meet every block of the other items;
    these meet each other, so that its own pairs, which are no news, are never made.
    """
    most = rows.groupBy("key", "c").agg(F.count("*").alias("own")).groupBy("key").agg(F.max_by("c", F.struct("own", "c")).alias("main"), F.max("own").alias("own"))
    blocks = lambda n: F.ceil(n / MEET).cast("int")
    both = rows.join(most, "key").withColumns({"mains": blocks(F.col("own")), "rests": blocks(F.col("size") - F.col("own"))})
    block = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    main = both.where("c = main").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
    # Places from 1 on under 0 are the main component's, so that they differ from those of the others.
    main = main.select("key", "item", "n", "c", "low", (-1 - block("mains")).alias("high"), F.lit(1).alias("side"))
    rest = both.where("c <> main").withColumn("own", block("rests")).withColumn("other", F.explode(F.sequence(-F.col("mains"), F.col("rests") - 1)))
    side = F.when(F.col("other") < 0, 0).when(F.col("other") == F.col("own"), BOTH).otherwise((F.col("own") > F.col("other")).cast("int"))
    low = F.when(F.col("other") < 0, F.col("own")).otherwise(F.least("own", "other"))
    high = F.when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("own", "other"))
    return main.union(rest.select("key", "item", "n", "c", low.alias("low"), high.alias("high"), side.alias("side")))


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy() // 8


def _near(percent: int):
    """Of pairs (a, b, n, m, sa, sb): those that sizes and short sketches allow."""

    def run(batches):
        for batch in batches:
            shorter = np.minimum(_lengths(batch.column("sa")), _lengths(batch.column("sb")))
            for length in np.unique(shorter).tolist():
                part = batch.filter(pa.array(shorter == length))
                n, m = part.column("n").to_numpy(), part.column("m").to_numpy()
                near = may_link(folded(part.column("sa"), length), n, folded(part.column("sb"), length), m, percent)[0]
                yield part.select(["a", "b"]).filter(pa.array(near))

    return run


#: Of the keys of a comparison: the block's key, and the blocks of items that meet.
MEETING = ["key", "low", "high"]


def _key_groups(batches):
    """Tables of the rows that meet, from rows sorted by ``MEETING``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in MEETING])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]] if keys.size else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(i, j - i)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in MEETING):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _apart(percent: int, nearest: bool, block: int = 128):
    """Of rows sorted by ``MEETING``: pairs of different components and sides that may be linked, found block by block.

    All of them, or for each item only the one whose sketch is nearest; then with its distance.  Rows of
    the side ``BOTH`` meet all others.
    """

    def run(batches):
        for group in _key_groups(batches):
            item, c, n, side = (group.column(x).to_numpy() for x in ("item", "c", "n", "side"))
            sketches = group.column("sketch").combine_chunks()
            sketch = folded(sketches, int(_lengths(sketches).min()))
            for i in range(0, len(item), block):
                a = slice(i, i + block)
                best, which = np.full(len(item[a]), np.inf), np.zeros(len(item[a]), np.int64)
                for j in range(0 if nearest else i, len(item), block):
                    b = slice(j, j + block)
                    near, share = may_link(sketch[a, None], n[a, None], sketch[None, b], n[None, b], percent)
                    near &= (c[a, None] != c[None, b]) & ((side[a, None] == BOTH) | (side[a, None] != side[None, b]))
                    if nearest:
                        share = np.where(near, share, np.inf)
                        k = share.argmin(axis=1)
                        value = share[np.arange(len(k)), k]
                        closer = value < best
                        best[closer], which[closer] = value[closer], item[b][k][closer]
                        continue
                    x, y = np.nonzero(near)
                    p, q = item[a][x], item[b][y]
                    p, q = np.minimum(p, q), np.maximum(p, q)
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])
                if nearest:
                    own = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(which[own]), pa.array(item[a][own]), pa.array(best[own])], ["a", "b", "distance"])

    return run


def _sets(text: str, size: int):
    def run(batches):
        for batch in W.pieces(batches, text):
            found = W.split(batch.column(text), W.BETWEEN_SPACES)
            doc, values = shingle_sets(found, size)
            sizes = np.bincount(doc, minlength=batch.num_rows)
            codes = set_codes(doc, values, batch.num_rows)
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), _long(values))
            yield pa.RecordBatch.from_arrays([_long(codes), lists], ["item", "shingles"]).filter(pa.array(sizes > 0))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is high enough, on whole sets."""
    left = sets.select(F.col("item").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("item").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("i", both)
        .where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i")))
        .select("a", "b")
        .distinct()  # an id that is repeated brings its sets twice
    )


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id reachable by links, the row's own included.  Null, empty and
    blank texts have no shingles and are linked with nothing.  Rows with a null id take part in links
    but never name a component unless all of its rows have none.  Repeated rows give repeated results.
    Other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    summaries = work.save(slim.mapInArrow(_summaries("doc_id", "text", size), f"doc_id {kind}, n long, item long, sketch binary"), "summaries")

    def fetch(owners: DataFrame, items: DataFrame) -> DataFrame:
        chosen = selecting.keep(slim, owners.select(F.col("owner").alias("doc_id")).where("doc_id is not null"))
        if not owners.where("owner is null").isEmpty():  # cannot be fetched by key
            chosen = chosen.union(slim.where("doc_id is null"))
        return chosen.select("text").mapInArrow(_sets("text", size), "item long, shingles array<long>")

    keys = slim.mapInArrow(_keys("text", size, percent), "key long, item long, n int")
    links = find_links(keys, summaries.withColumnRenamed("doc_id", "owner"), fetch, work, percent)
    groups = components(links, work)
    firsts = summaries.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(groups, firsts.item == groups.node, "left").select(
        "item", "first", F.coalesce("component", "item").alias("root")
    )
    rooted = work.save(rooted, "rooted")
    heads = work.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
    named = work.save(rooted.join(heads, "root").select("item", "component_id"), "named")
    return summaries.join(named, "item", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def find_links(keys: DataFrame, summaries: DataFrame, fetch, work: Workspace, percent: int) -> DataFrame:
    """Verified links (a, b) between items that connect every component.

    ``keys`` has (key, item, n), repeated or not: items that may be linked share a key.
    ``summaries`` has (item, sketch, owner) and ``fetch(owners, items)`` gives (item, shingles) of at
    least the items in the one, which are found with the other table's owners.
    """
    spark = keys.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = keys.repartition(parts, "key").sortWithinPartitions("key", "item")
    shared = work.save(dealt.mapInArrow(_collisions, "key long, item long, n int, pivot long, pivot_n int"), "shared")

    items = shared.select("item").distinct()
    owners = summaries.join(items, "item", "left_semi").groupBy("item")
    owners = work.save(owners.agg(F.min("owner").alias("owner"), F.first("sketch").alias("sketch")), "owners")
    sketches = owners.select("item", "sketch")
    def fetched(pairs: DataFrame, name: str) -> DataFrame:
        used = work.save(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "used")
        own = work.save(owners.join(used, "item", "left_semi").select("owner").distinct(), "ids")
        return work.save(fetch(own, used), name)

    def verified(pairs: DataFrame) -> DataFrame:
        held = fetched(pairs, "sets")
        out = work.save(_verified(pairs, held, percent), "links")
        work.drop(held)
        return out

    def near_pairs(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n, m), each once: those that sizes and short sketches allow."""
        both = pairs.distinct().join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
        return both.mapInArrow(_near(percent), "a long, b long")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    stars = shared.where("item <> pivot").select(
        F.col("pivot").alias("a"), F.col("item").alias("b"), F.col("pivot_n").alias("n"), F.col("n").alias("m")
    )
    stars = near_pairs(stars).groupBy("b").agg(F.min("a").alias("a"))
    tested = work.save(ordered(stars), "stars")
    links = verified(tested)
    for nearest in (True, False):
        # Items of one key that are still apart: first each with its nearest, then all that are left.
        groups = components(links, work)
        placed = shared.join(groups.withColumnRenamed("node", "item"), "item", "left").select(
            "key", "item", "n", F.coalesce("component", "item").alias("c")
        )
        ends = [f(F.struct("item", "n")).alias(name) for f, name in ((F.min, "first"), (F.max, "last"))]
        mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), *ends)
        mixed = work.save(mixed.where("lo <> hi").drop("lo", "hi"), "mixed")
        apart = placed.join(mixed.where(f"size > 2 and size <= {MEET}").select("key"), "key", "left_semi")
        apart = apart.select("key", "item", "n", "c", *(F.lit(x).alias(name) for name, x in (("low", 0), ("high", 0), ("side", BOTH))))
        large = mixed.where(f"size > {MEET}").select("key", "size")
        if not large.isEmpty():
            apart = apart.union(_split_groups(placed.join(large, "key")))
        apart = apart.join(sketches, "item").select(*MEETING, "side", "item", "n", "c", "sketch")
        apart = apart.repartition(parts, *MEETING).sortWithinPartitions(*MEETING)
        if nearest:
            found = apart.mapInArrow(_apart(percent, True), "a long, b long, distance double")
            pairs = found.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b")
            # Keys of two items need no choice.
            couples = mixed.where("size = 2").select("first.item", "last.item", "first.n", "last.n").toDF("a", "b", "n", "m")
            pairs = pairs.union(near_pairs(couples))
        else:
            pairs = apart.mapInArrow(_apart(percent, False), "a long, b long")
        pairs = work.save(ordered(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        links, tested = links.unionByName(verified(pairs)), tested.unionByName(pairs)
    return links


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = NEAR_SHINGLE, percent: int = NEAR_PERCENT
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows without words are linked with nothing and stay; a row repeated as a whole stays once if its
    id is not null.
    """
    work = Workspace(docs.sparkSession, "ngram-dedup")
    found = work.save(join(docs, key, text, size, percent), "found")
    gone = work.save(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    kept = selecting.drop(docs, gone, key)
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    twice = work.save(twice.select(F.col("doc_id").alias(key)), "twice")
    if twice.isEmpty():
        return kept
    return selecting.drop(kept, twice, key).unionByName(selecting.keep(kept, twice, key).dropDuplicates([key, text]))
