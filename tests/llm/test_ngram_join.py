import random
import re

import numpy as np
import pytest

from spanloom.llm import ngram_join as J


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, percent=85, size=4):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 60)}"
    say = lambda k: [word() for _ in range(k)]
    common = say(25)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                spot = rng.randrange(len(base) + 1)
                base[spot : spot + rng.randint(0, 1)] = say(rng.randint(0, 1))
            words = base
        else:
            words = (common if rng.random() < 0.3 else []) + say(rng.choice([1, 3, 4, 5, 7, 9, 12, 20, 40, 120]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n\t"), (5, corpus(seed)[5][1]), (903, "É x y"), (904, "É X Y"), (None, "q r s t u v"), (905, "q r s t u v")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    assert sorted((tuple(r) for r in J.join(frame).collect()), key=str) == brute(rows)


def test_blocks_never_miss_a_link_between_small_sets():
    rng = np.random.default_rng(4)
    bands = J.Bands()
    for _ in range(400):
        n = int(rng.integers(6, 60))
        most = 15 * 2 * n // 185
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = int(rng.integers(0, most + 1))
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, most - gone, dtype=np.uint64)])
        if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        row, key = J.block_keys(doc, np.r_[a, b], np.array([len(a), len(b)]), bands)
        assert set(a) == set(b) or set(key[row == 0]) & set(key[row == 1])


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    # Chains of near copies around one text, so that keys hold several components of different sizes.
    monkeypatch.setattr(J, "MEET", 5)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    rows = []
    for i in range(140):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in J.join(docs).collect()), key=str) == brute(rows)


def test_deduplicate_keeps_one_of_each_group(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en"), (2, text.upper(), "en"), (2, text.upper(), "en"), (3, "other words stand here now", "de"), (3, "other words stand here now", "de"), (4, None, None), (5, "", "x")]
    got = J.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5] and got.columns == ["doc_id", "text", "lang"]


def test_no_rows(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_key_may_span_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 12, 200))
    item = rng.integers(0, 9, 200)
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(item), pa.array(item.astype(np.int32))], ["key", "item", "n"])
    want = {(k, i, min(item[key == k])) for k, i in zip(key, item) if len(set(item[key == k])) > 1}
    for step in (1, 3, 200):
        parts = [whole.slice(i, step) for i in range(0, 200, step)]
        got = [(r["key"], r["item"], r["pivot"]) for b in J._collisions(iter(parts)) for r in b.to_pylist()]
        assert set(got) == want
