"""Alike texts: clusters by leaders, merged clusters, texts given to clusters, and the pairs that all of them rest on."""

import random

from spanloom.operators import rca, similar
from spanloom.session import Workspace


def texts(n: int, seed: int, vocabulary: int = 60) -> list[str]:
    """Few words, so that many texts have frequent ones only; every third is an earlier one with a word changed."""
    mark, out = random.Random(seed), []
    for i in range(n):
        words = mark.sample(range(vocabulary), mark.randint(0, 14)) if i % 3 else (out[mark.randrange(len(out))].split() if out else [])
        words = [w if isinstance(w, str) else f"word{w}" for w in words]
        if words and not i % 3:
            words[mark.randrange(len(words))] = f"word{mark.randrange(vocabulary)}"
        out.append(" ".join(words))
    return out


def jaccard(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x | y else 0.0


def test_pairs_that_meet_hold_all_that_are_alike_and_few_others(spark):
    rows = texts(240, 1)
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, text string").selectExpr("0L as g", "id", "text").select("g", "id", similar.words("text").alias("w"))
    want = {(i, j) for i in range(240) for j in range(i + 1, 240) if jaccard(rows[i], rows[j]) >= 0.7}
    got = [(r.a, r.b) for r in similar.near(frame, frame, 0.7, True).collect()]
    assert want <= set(got) and len(got) == len(set(got)) < 4 * len(want)
    one, other = frame.where("id < 100"), frame.where("id >= 100")
    assert {p for p in want if p[0] < 100 <= p[1]} <= {(r.a, r.b) for r in similar.near(one, other, 0.7).collect()}


def test_greedy_clusters_without_a_task_a_key(spark):
    rows = [(f"k{i % 2}", i, t) for i, t in enumerate(texts(200, 2))] + [("k0", 900, None), (None, 901, "alpha beta"), (None, 902, "beta alpha")]
    want, leaders = {}, {}
    for key, seq, text in rows:
        own = leaders.setdefault(key, [])
        alike = (s for s, t in own if jaccard(t, text or "") >= 0.7 or not (t or (text or "")))
        want[key, seq] = next(alike, seq)
        if want[key, seq] == seq:
            own.append((seq, text or ""))
    found = rca.greedy_clusters(spark.createDataFrame(rows, "key string, seq long, text string"), 0.7, 1)
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.key, r.seq): r.leader for r in found.collect()} == want and 20 < len(set(want.values())) < 190


def test_copies_of_clusters_are_linked_with_nothing(spark):
    rows = [(i, "alpha beta gamma delta", ["en"], 1) for i in range(300)] + [(i, "alpha beta gamma delta", [], 1) for i in range(300, 310)] + [(400, "other words", None, 1)]
    work = Workspace(spark, "merge")
    merged = rca.merge_clusters(work, spark.createDataFrame(rows, "cluster long, representative string, keywords array<string>, size long"))
    assert {r.cluster: r.leader for r in merged.collect()} == {i: 0 if i < 300 else i for i, *_ in rows}
    assert spark.read.parquet(f"{work.root}/links-*").count() == 0


def test_copies_are_assigned_as_one(spark):
    clusters = [(5, "alpha beta gamma"), (3, "gamma beta alpha"), (7, "other words here")]
    rows = [(i, "alpha beta gamma!") for i in range(50)] + [(60, "nothing alike"), (61, None), (62, "here other words")]
    found = rca.assign_to_clusters(spark.createDataFrame(rows, "seq long, text string"), spark.createDataFrame(clusters, "cluster long, representative string"))
    assert {r.seq: r.cluster for r in found.collect()} == {**dict.fromkeys(range(50), 3), 60: None, 61: None, 62: 7}
    # What is compared word by word comes from tables in which copies stand once.
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def led(rows: list[tuple]) -> dict:
    """Leaders by plain comparison of (key, seq, text), 0.7 alike."""
    want, leaders = {}, {}
    for key, seq, text in rows:
        own = leaders.setdefault(key, [])
        want[key, seq] = next((s for s, t in own if jaccard(t, text) >= 0.7), seq)
        if want[key, seq] == seq:
            own.append((seq, text))
    return want


def drifting(n: int, size: int, seed: int, changed: int) -> list[str]:
    """Texts of one large group: each is an earlier one with some words changed, so that first and last are far apart."""
    mark, out = random.Random(seed), [[f"word{i}" for i in range(size)]]
    for i in range(n - 1):
        words = list(out[mark.randrange(max(0, i - 40), i + 1)])
        for _ in range(mark.randint(0, changed)):
            words[mark.randrange(len(words))] = f"word{mark.randrange(4 * size)}"
        out.append(list(dict.fromkeys(words)))
    return [" ".join(w) for w in out]


def test_pairs_of_a_group_of_near_copies_grow_with_it_not_with_its_square(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rca, "Workspace", lambda *a: made.append(Workspace(*a)) or made[-1])
    rows = [("k", i, " ".join([f"word{j}" for j in range(40) if j != i % 40] + [f"own{i}"])) for i in range(400)]
    found = rca.greedy_clusters(spark.createDataFrame(rows, "key string, seq long, text string"), 0.7, 2)
    assert {(r.seq, r.leader, r.size) for r in found.collect()} == {(i, 0, 400) for i in range(400)}
    assert spark.read.parquet(f"{made[0].root}/links-*").count() < 400 * 20


def test_greedy_clusters_whose_first_comparisons_leave_rows_open(spark, monkeypatch):
    rows = [("k", i, t) for i, t in enumerate(drifting(260, 20, 1, 4))] + [("m", i, t) for i, t in enumerate(drifting(160, 90, 2, 12))]
    frame = spark.createDataFrame(rows, "key string, seq long, text string")
    want = led(rows)
    assert 10 < len({(k, v) for (k, _), v in want.items()}) < 300
    for few, first in ((20_000, 1), (0, 3)):
        monkeypatch.setattr(rca, "FEW", few)
        monkeypatch.setattr(rca, "FIRST", first)
        monkeypatch.setattr(rca, "MORE", 2)
        monkeypatch.setattr(rca, "PAIRS", 1)
        assert {(r.key, r.seq): r.leader for r in rca.greedy_clusters(frame, 0.7, 1).collect()} == want


def test_pairs_of_large_sets_and_of_frequent_words_are_all_there(spark, monkeypatch):
    rows = [t for k, size in enumerate((30, 45, 66, 100, 300)) for t in drifting(60, size, k, size // 6)]
    cut = random.Random(7)
    rows += [" ".join(w for w in t.split() if cut.random() < 0.8) for t in rows]
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, text string").selectExpr("0L as g", "id", "text").select("g", "id", similar.words("text").alias("w"))
    one, other = frame.where("id % 2 = 0"), frame.where("id % 2 = 1")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(rows[i], rows[j]) >= 0.7}
    for block in (similar.BLOCK, 9):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = {(r.a, r.b) for r in similar.near(frame, frame, 0.7, True).collect()}
        assert want <= got and len(want) > 1000 and all(a < b for a, b in got)
        met = {(r.a, r.b) for r in similar.near(one, other, 0.7).collect()}
        assert {p for i, j in want for p in ((i, j), (j, i)) if p[0] % 2 == 0 and p[1] % 2} <= met
