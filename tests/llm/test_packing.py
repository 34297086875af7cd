import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spanloom.llm import packing
from spanloom.llm.queries import QUERIES

VOCABULARY = packing.Vocabulary(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType()), T.StructField("part", T.StringType())])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY.json)


def hold(rows, docs, tokenizer, capacity):
    """Every document's ids lie in the sequences whole, in order and without gaps or overlaps."""
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in docs.items()}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(ids)
    for k, found in by.items():
        at = 0
        for n, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            assert r.length == capacity or n == 0
            at += r.length
        assert at == len(ids[k]) and len(found) == -(-at // capacity)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(map(len, ids.values()))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    mark = random.Random(3)
    texts = ["", "a<|endoftext|>b", "<|endoftext", " " * 200_000 + "x", "x" * 100_000, "\n\n\t 12 345's don't DON'T", "　 é é 日本語 🎉🏽"]
    texts += ["".join(chr(mark.choice([*range(32, 127), *range(0xA0, 0x250), *range(0x3040, 0x30FF), 9, 10, 0x1F600])) for _ in range(80)) for _ in range(200)]
    for text in texts:
        assert packing.token_ids(VOCABULARY, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query(spark, tokenizer):
    import duckdb

    folder = "/root/testdata/sf0.001"
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    many, tokens = hold(QUERIES["op12_best_fit_packing"](spark, folder).collect(), docs, tokenizer, 2048)
    assert many <= -(-tokens // 2048) + 1


def test_small_capacity_repeats_and_odd_rows(spark, tokenizer):
    mark = random.Random(4)
    docs = {i: None if i % 50 == 0 else " ".join(mark.choices(["one", "two", "three", "x"], k=mark.choice([0, 1, 2, 3, 5, 8, 31, 32, 95, 200]))) for i in range(600)}
    rows = spark.createDataFrame([(k, t, "a", "b") for k, t in docs.items()], SCHEMA).repartition(5)
    many, tokens = hold(packing.pack(rows, VOCABULARY, capacity=32).collect(), docs, tokenizer, 32)
    assert many <= 1.02 * tokens / 32 + 1
    twice = rows.union(rows).union(spark.createDataFrame([(None, "of no one", None, None)] * 2, SCHEMA))
    got = packing.pack(twice, VOCABULARY, capacity=32).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and Counter(r.doc_id for r in got)[None] == 2
    assert packing.pack(rows.limit(0), VOCABULARY).collect() == []


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1))
def test_plans(counts):
    plan = packing.plan(counts, 64)
    held = Counter()
    for copies, holds in zip(plan.copies, plan.holds):
        assert copies > 0 and sum(a * b for a, b in holds) <= 64
        for length, many in holds:
            held[length] += copies * many
    assert held == counts
    assert plan.sequences >= plan.bound - 1e-6
    large = sum(n for length, n in counts.items() if length > 32)
    assert plan.sequences <= 1.25 * max(plan.bound, sum(a * b for a, b in counts.items()) / 64, large) + 1
    runs = plan.entries()
    assert sum(runs["copies"]) and len(runs["run"]) == sum(map(len, plan.holds))


def test_plan_is_near_its_bound():
    mark = np.random.default_rng(7)
    counts = Counter(np.minimum(mark.lognormal(4.5, 1.0, 40_000).astype(int) + 1, 511).tolist())
    plan = packing.plan(counts, 512)
    assert plan.sequences <= plan.bound * 1.001 + 2


def test_knapsack_against_all_multisets():
    mark = random.Random(9)
    for _ in range(50):
        values = np.array([0.0, *(mark.choice([0, 0, mark.random()]) for _ in range(12))])
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max(best[c - 1], *(best[c - k] + values[k] for k in range(1, c + 1)))
        for taken, many, worth in packing.configurations(values):
            assert worth == pytest.approx(best[12]) and taken @ many <= 12
            assert values[taken] @ many >= worth - packing.NEAR - 1e-9
