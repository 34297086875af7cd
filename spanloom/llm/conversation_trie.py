"""A trie of conversations by their turns, with counts and savings for every shared beginning.

Conversations travel as hashed turns, never as text.  A beginning is the exclusive or of its turns' hashes, each mixed
with its depth, so that it can be carried along rows that are sorted over many tasks.  Beginnings with more than
``SHARD`` rows below them are the heavy upper levels: they are counted by Spark and merged by pointer doubling.  What
hangs below them are whole subtrees of at most ``SHARD`` rows; numpy builds succinct level-order tries of these,
thousands of subtrees in one, and rolls them up from the last level to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.selecting import BROADCAST_KEYS
from spanloom.session import Workspace

#: Rows (turns of a conversation) of a subtree that one trie holds; a larger subtree's top is heavy.
SHARD = 1024
#: Rows after which a task builds a trie of the subtrees that it has read.
CHUNK = 1 << 18
#: Conversations whose ends are joined to one text before they are hashed in order.
ENDS = 8192
_NOBODY = hashlib.sha256(b"").hexdigest()
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, h1, h2, bytes): a hash of role and text, null counting as empty, and the text's UTF-8 bytes.

    Rows without a conversation are left out.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    lane = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    return rows.where("conv is not null").select("conv", "turn", lane(1).alias("h1"), lane(17).alias("h2"), "bytes")


def running(work: Workspace, rows: DataFrame, order: list[str], xors: list[str] = ()) -> DataFrame:
    """``rows`` with ``nth``, their place in their conversation, and running exclusive ors in ``xors``.

    Rows are dealt by ranges of (conv, order), so that a long conversation spans many tasks.  Each task counts
    from its own first row; what a conversation had in earlier tasks is added from one row a task.
    """
    dealt = rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    schema = T.StructType([*dealt.schema.fields, T.StructField("nth", T.LongType()), T.StructField("part", T.IntegerType())])
    at = {name: dealt.columns.index(name) for name in ["conv", *xors]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, many, held = None, 0, [0] * len(xors)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(at["conv"]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
            goes_on = (group == 0) & (conv[0] == last)
            nth = np.arange(n) - first[group] + 1 + goes_on * many
            columns = list(batch.columns)
            for i, name in enumerate(xors):
                x = np.bitwise_xor.accumulate(columns[at[name]].to_numpy(zero_copy_only=False))
                x = x ^ np.r_[0, x[first[1:] - 1]].astype(np.int64)[group] ^ np.where(goes_on, np.int64(held[i]), np.int64(0))
                columns[at[name]], held[i] = pa.array(x), x[-1]
            last, many = conv[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nth), pa.array(np.full(n, part, np.int32))], schema.names)

    local = work.save(dealt.mapInArrow(run, schema), "running")
    tails = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by(F.struct("nth", *xors), F.struct("conv", "nth")).alias("state"))
    carried, last, state = [], None, None
    for r in sorted(tails.collect(), key=lambda r: r.part):  # one row a task
        if last == r.first:
            carried.append((r.part, r.first, *state))
            mine = state if r.first == r.last else (0,) * len(state)
        else:
            mine = (0,) * (1 + len(xors))
        last, state = r.last, (r.state[0] + mine[0], *(a ^ b for a, b in zip(r.state[1:], mine[1:])))
    out = local
    if carried:
        names = ["nth", *xors]
        kinds = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("conv", T.LongType()), *(T.StructField("had_" + n, T.LongType()) for n in names)])
        had = F.broadcast(work.spark.createDataFrame(carried, kinds))
        zero = lambda n: F.coalesce("had_" + n, F.lit(0))
        out = local.join(had, ["part", "conv"], "left").withColumns({"nth": F.col("nth") + zero("nth")} | {n: F.col(n).bitwiseXOR(zero(n)) for n in xors})
    return out.drop("part")


def numbered(work: Workspace, conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv, nth, h1, h2, bytes): turns in order, null first; equal turns by the hash of role and text."""
    return running(work, turns(conversations, **columns), ["turn", "h1", "h2"]).drop("turn")


def plain(work: Workspace, turns_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, len) and (conv, depth, len, h1, h2, bytes)."""
    convs = work.save(turns_.groupBy("conv").agg(F.max("nth").alias("len")), "convs")
    return convs, turns_.withColumnRenamed("nth", "depth").join(convs, "conv")


def spliced(work: Workspace, turns_: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain`, each conversation with its first turns taken from another.

    Conversation c gets the first h turns of the one numbered c - c mod ``every`` (all if fewer, none if
    it is absent), then its own after its first h; h = crc32 of c's digits mod ``most``.  The remainder is never negative.
    """
    own = work.save(turns_.groupBy("conv").agg(F.max("nth").alias("own")), "own")
    h = F.crc32(F.col("conv").cast("string")) % most
    head = F.col("conv") - F.pmod("conv", F.lit(every))
    heads = own.select(F.col("conv").alias("head"), F.col("own").alias("head_own"))
    convs = own.select("conv", "own", h.alias("h"), head.alias("head")).join(heads, "head", "left")
    taken = F.least("h", F.coalesce("head_own", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = work.save(convs.select("conv", "head", "h", "taken", "len"), "convs")
    rest = turns_.join(convs.drop("head"), "conv").where("nth > h").select("conv", (F.col("taken") + F.col("nth") - F.col("h")).alias("depth"), "len", "h1", "h2", "bytes")
    lent = turns_.where((F.pmod("conv", F.lit(every)) == 0) & (F.col("nth") < most)).withColumnRenamed("conv", "head")
    lent = lent.join(convs.drop("h"), "head").where("nth <= taken").select("conv", F.col("nth").alias("depth"), "len", "h1", "h2", "bytes")
    return convs, lent.unionByName(rest)


class Louds:
    """A level-order trie: a bit for each child, ended by 0, node after node; node 0 stands above all subtrees.

    ``of_row`` has the node of each row; ``key``, ``depth`` and ``size`` (bytes of the last text) are labels of the nodes.
    """

    def __init__(self, rows: dict[str, np.ndarray]):
        n = len(rows["conv"])
        along = np.lexsort((rows["depth"], rows["conv"]))
        by_key = np.lexsort((rows["k2"], rows["k1"]))
        k1, k2 = rows["k1"][by_key], rows["k2"][by_key]
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        name = np.empty(n, np.int64)
        name[by_key] = np.cumsum(new) - 1
        sample = by_key[new]  # a row of each name
        many = len(sample)
        above = np.full(many, -1, np.int64)  # the parent's name
        a, b = along[:-1], along[1:]
        follows = rows["conv"][a] == rows["conv"][b]
        above[name[b[follows]]] = name[a[follows]]
        rank, levels = np.full(many, -1, np.int64), []
        level = rows["depth"][sample] - rows["top"][sample]
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(level.max() + 2))
        at = 1
        for lo, hi in zip(ends, ends[1:]):
            here = order[lo:hi]
            if lo:
                here = here[np.lexsort((here, rank[above[here]]))]
            rank[here] = np.arange(at, at + len(here))
            levels.append((at, at + len(here)))
            at += len(here)
        self.levels = levels
        self.of_row = rank[name]
        in_order = np.empty(many, np.int64)
        in_order[rank - 1] = np.arange(many)
        self.row = sample[in_order]  # of node 1, 2, ...
        parents = np.where(above >= 0, rank[above], 0)[in_order]
        degree = np.bincount(parents, minlength=many + 1)
        bits = np.ones(2 * many + 1, np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        self.bits, self.length = np.packbits(bits), len(bits)

    @property
    def parent(self) -> np.ndarray:
        """Of node 1, 2, ...: as many nodes ended before its bit."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.length))
        return ones - np.arange(len(ones))

    @property
    def children(self) -> np.ndarray:
        """Of node 0, 1, 2, ...: the bits up to its 0."""
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.length) == 0)
        return np.diff(np.r_[-1, zeros]) - 1

    def roll_up(self, values: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Sums over subtrees, level by level from the last; ``values`` by node from 0."""
        for lo, hi in reversed(self.levels):
            np.add.at(values, parent[lo - 1 : hi - 1], values[lo:hi])
        return values


NODE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [T.StructField("ends_sha256", T.StringType()), *(T.StructField(n, T.LongType()) for n in PARENT)]
)


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _trie(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each node of these whole subtrees; tops have the key of the heavy node above them."""
    trie = Louds(rows)
    parent, children, many = trie.parent, trie.children, len(trie.row)
    ending = np.flatnonzero(rows["len"] == rows["depth"])
    convs = np.zeros(many + 1, np.int64)
    np.add.at(convs, trie.of_row[ending], 1)
    convs = trie.roll_up(convs, parent)
    least = np.full(many + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, trie.of_row, rows["conv"])
    leaves = trie.roll_up((children == 0).astype(np.int64), parent)
    saved = np.zeros(many + 1, np.int64)
    saved[1:] = (convs[1:] - 1) * rows["bytes"][trie.row]
    saved = trie.roll_up(saved, parent)
    digests = np.full(many + 1, _NOBODY, object)
    ending = ending[np.lexsort((rows["conv"][ending], trie.of_row[ending]))]
    nodes, first = np.unique(trie.of_row[ending], return_index=True)
    for node, ids in zip(nodes, np.split(rows["conv"][ending], first[1:])):
        digests[node] = _digest(ids.tolist())
    top = parent == 0
    columns = [least[1:], rows["depth"][trie.row], pa.array(least[parent], mask=top), convs[1:], children[1:], leaves[1:], saved[1:], pa.array(digests[1:].tolist(), pa.string())]
    columns += [pa.array(rows[n][trie.row], mask=~top) for n in PARENT]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], NODE.names)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of whole subtrees, from rows sorted by subtree."""
    held: list[dict[str, np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        held.append(rows)
        count += batch.num_rows
        if count < CHUNK:
            continue
        rows = {n: np.concatenate([h[n] for h in held]) for n in rows}
        changes = np.flatnonzero((rows["u1"][1:] != rows["u1"][:-1]) | (rows["u2"][1:] != rows["u2"][:-1]))
        whole = int(changes[-1]) + 1 if len(changes) else 0
        if whole:
            yield _trie({n: v[:whole] for n, v in rows.items()})
        held, count = [{n: v[whole:] for n, v in rows.items()}], len(rows["conv"]) - whole
    if count:
        yield _trie({n: np.concatenate([h[n] for h in held]) for n in held[0]})


def _ends(work: Workspace, ended: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of heavy nodes from (k1, k2, conv).

    Numbers are sorted and joined in blocks all over the cluster; the digest itself can only be taken in
    order, so that one task a node reads the joined blocks one after the other and holds no more than a few.
    """
    block = F.floor(F.col("conv") / ENDS)
    texts = ended.groupBy(*KEY, block.alias("block")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    texts = texts.select(*KEY, "block", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids"))):
                if (k1, k2) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    yield pa.RecordBatch.from_pydict(dict(k1=[key[0]], k2=[key[1]], ends_sha256=[digest.hexdigest()]))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
        if digest:
            yield pa.RecordBatch.from_pydict(dict(k1=[key[0]], k2=[key[1]], ends_sha256=[digest.hexdigest()]))

    dealt = work.save(texts, "ends").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    return work.save(dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string"), "digests")


def _merged(work: Workspace, upper: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` of (k1, k2, p1, p2, leaves, saved) summed over subtrees, by pointer doubling.

    Each round adds the sums of the nodes that point at a node, then every pointer jumps to where its
    node's pointer leads: rounds are the logarithm of the depth, whatever the shape of the tree.
    """
    state = work.save(upper, "upper")
    while not (moving := state.where("p1 is not null")).isEmpty():
        sums = moving.groupBy(*PARENT).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = sums.toDF(*KEY, "more_leaves", "more_saved")
        jumps = state.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        after = state.join(sums, KEY, "left").join(jumps, PARENT, "left")
        plus = lambda n: F.col(n) + F.coalesce("more_" + n, F.lit(0))
        after = after.select(*KEY, F.col("q1").alias("p1"), F.col("q2").alias("p2"), plus("leaves").alias("leaves"), plus("saved").alias("saved"))
        after = work.save(after, "upper")
        work.drop(state)
        state = after
    return state.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def nodes(work: Workspace, convs: DataFrame, path: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie's nodes from (conv, len) and (conv, depth, len, h1, h2, bytes), both of :func:`plain` or :func:`spliced`.

    The root is a row of its own, with every conversation as a member; without conversations there is none.
    """
    mixed = path.withColumns({"k1": F.xxhash64("h1", "h2", "depth"), "k2": F.xxhash64(F.lit("second"), "depth", "h2", "h1")})
    mixed = mixed.select("conv", "depth", "len", "bytes", *KEY, F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    rows = running(work, mixed, ["depth"], KEY).drop("nth")
    rows = rows.select("conv", "depth", "len", "bytes", *KEY, F.col("k1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("p2"))

    counted = rows.groupBy(*KEY).agg(
        *(F.min(n).alias(n) for n in ("depth", "bytes", *PARENT)),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv_id"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
    )
    heavy = work.save(counted.where(F.col("weight") > shard).drop("weight"), "heavy")
    hint = F.broadcast if heavy.count() <= BROADCAST_KEYS else (lambda df: df)
    keys = hint(heavy.select(*KEY))
    light = rows.join(keys, KEY, "left_anti")
    # a conversation's rows below the heavy nodes lie in one subtree, of at most `shard` rows
    first = F.first(F.struct(*KEY, "depth")).over(Window.partitionBy("conv").orderBy("depth"))
    light = light.withColumn("top", first).select("conv", "depth", "len", "bytes", *KEY, *PARENT, F.col("top.k1").alias("u1"), F.col("top.k2").alias("u2"), F.col("top.depth").alias("top"))
    tries = work.save(light.repartition("u1", "u2").sortWithinPartitions("u1", "u2").mapInArrow(_build, NODE), "tries")

    everyone = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = everyone.select(*(F.lit(0).cast("long").alias(n) for n in (*KEY, "depth", "bytes")), none.alias("p1"), none.alias("p2"), "n_convs", "conv_id")
    upper = work.save(heavy.select(*root.columns).union(root), "nodes")
    below = tries.where("p1 is not null").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = heavy.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("inner"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    own = upper.join(below.withColumnsRenamed(dict(zip(PARENT, KEY))), KEY, "left").join(inner.withColumnsRenamed(dict(zip(PARENT, KEY))), KEY, "left")
    n_children = zero("tops") + zero("inner")
    own = work.save(
        own.select(*KEY, *PARENT, n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(zero("leaves")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes") + zero("saved")).alias("saved")), "own"
    )
    summed = _merged(work, own.drop("n_children"))
    ended = rows.where("len = depth").join(keys, KEY, "left_semi").select(*KEY, "conv")
    ended = ended.union(convs.where("len = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv"))
    names = [f.name for f in NODE if f.name not in PARENT]
    over = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = upper.join(own.select(*KEY, "n_children"), KEY).join(summed, KEY).join(_ends(work, ended), KEY, "left").join(hint(over), PARENT, "left")
    top = top.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY))).select(*names)
    hung = tries.where("p1 is not null").drop("parent_conv_id").join(hint(over), PARENT, "left").select(*names)
    return top.union(hung).union(tries.where("p1 is null").select(*names))


def prefix_trie(conversations: DataFrame, shard: int = SHARD, **columns: str) -> DataFrame:
    """A row for each distinct beginning of conversations: see :func:`spliced_trie`, without its splicing."""
    work = Workspace(conversations.sparkSession, "trie")
    return nodes(work, *plain(work, numbered(work, conversations, **columns)), shard)


def spliced_trie(conversations: DataFrame, shard: int = SHARD, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of spliced conversations.

    Turns are ordered by number, null first; equal numbers by a hash of role and text, so that repeated
    rows are turns of their own.  Null roles and texts count as empty; rows without a conversation are
    left out; other columns are ignored.  ``conv_id`` is the smallest member, ``saved_tokens`` the bytes
    that a subtree's shared turns need not be read again, ``ends_sha256`` the digest of the members that end
    there.  An empty table gives no rows.  Turns are told apart by 128 bits of their SHA-256, beginnings by 128 bits of
    these, mixed.
    """
    work = Workspace(conversations.sparkSession, "trie")
    return nodes(work, *spliced(work, numbered(work, conversations, **columns)), shard)
