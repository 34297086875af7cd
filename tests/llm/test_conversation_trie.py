import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from spanloom.llm import conversation_trie
from spanloom.llm.queries import QUERIES

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("k1", T.StringType()), T.StructField("part", T.StringType())]
)


def plain(rows, splice=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            lanes = [int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8)]
            own[conv].append(((turn is not None, turn or 0, *lanes), role, text))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    built = own
    if splice:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    below = defaultdict(set)
    for path in members:
        if path:
            below[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        mine = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = mine + sum(saved[p] for p in below[path])
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        out.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(below[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in frame.collect()), key=str)


def conversations(mark, n, texts=3):
    rows = []
    for c in range(n):
        conv = mark.choice([c, c, 2 * c + 1])
        for turn in range(mark.choice([1, 2, 3, 5, 8, 12])):
            number = mark.choice([turn, turn, turn, turn + 1, None])
            rows.append((conv, number, mark.choice(["user", "user", None]), mark.choice([None, "", "äb", *"xyz"[:texts]])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard", [1, 7, 60, 4096])
def test_against_a_plain_trie(spark, shard):
    mark = random.Random(shard)
    rows = conversations(mark, 90)
    rows += [(None, 0, "user", "nobody's")] + rows[:30]
    rows += [(500 + i, t, "user", "x") for i in range(60) for t in range(10)]  # copies
    rows += [(900, t, "user", str(t // 3)) for t in range(150)]  # a long one
    source = frame(spark, rows).repartition(7)
    assert got(conversation_trie.spliced_trie(source, shard)) == plain(rows)


def test_without_splicing_and_long_conversation_in_many_tasks(spark):
    rows = [(7, t, "user", str(t % 4)) for t in range(2000)] + [(8, t, "user", str(t % 4)) for t in range(1500)] + [(3, 0, None, None)]
    assert got(conversation_trie.prefix_trie(frame(spark, rows).repartition(5), 100)) == plain(rows, splice=False)


def test_empty_and_turnless(spark):
    assert got(conversation_trie.spliced_trie(frame(spark, []))) == []
    turnless = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(turnless, 0, "user", "lost")]
    assert got(conversation_trie.spliced_trie(frame(spark, rows))) == plain(rows)
    assert plain(rows)[0][:2] == (turnless, 0)


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 1)
    rows = conversations(random.Random(1), 60)
    names = ["conv", "depth", "len", "bytes", "k1", "k2", "p1", "p2", "u1", "u2", "top"]
    import pyarrow as pa

    def batches(size):
        columns = {n: [] for n in names}
        for conv in range(40):
            for depth in range(1, 6):
                for n, v in zip(names, (conv, depth, 5, 1, (conv // 4) * 10 + depth, 0, (conv // 4) * 10 + depth - 1, 0, conv // 4, 0, 1)):
                    columns[n].append(v)
        table = pa.table({n: np.array(v, np.int64) for n, v in columns.items()})
        return table.to_batches(max_chunksize=size)

    whole = [b.to_pylist() for b in conversation_trie._build(iter(batches(1000)))]
    parts = [b.to_pylist() for b in conversation_trie._build(iter(batches(7)))]
    key = lambda r: (r["conv_id"], r["depth"])
    assert len(parts) > len(whole) and sorted(sum(parts, []), key=key) == sorted(sum(whole, []), key=key)
    assert got(conversation_trie.spliced_trie(frame(spark, rows))) == plain(rows)


def test_query(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    assert got(QUERIES["op13_conversation_prefix_trie"](spark, folder)) == plain(rows)
