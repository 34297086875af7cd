import math
import random
import re
from collections import Counter

import pytest

from spanloom.llm import lm_score as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, good):
    """The same models with dictionaries."""
    pair, hist, uni = ([Counter(), Counter()] for _ in range(3))
    texts = [(d, ["<s>", *words(t)]) for d, t in rows]
    for d, w in texts:
        for k in {0, int(d in good)}:
            pair[k].update(zip(w, w[1:]))
            hist[k].update(w[:-1])
            uni[k].update(w[1:])
    total = [sum(u.values()) for u in uni]
    scale = [total[1] / total[0] if total[0] and total[1] else 1.0, 1.0]

    def loss(k, h, w):
        u = (scale[k] * uni[k][w] + 1) / (scale[k] * total[k] + len(uni[0]) + 1)
        return math.log(scale[k] * hist[k][h] + L.PRIOR) - math.log(scale[k] * pair[k][h, w] + L.PRIOR * u)

    out = []
    for d, w in texts:
        both = list(zip(w, w[1:]))
        means = [sum(loss(k, *p) for p in both) / len(both) if both else None for k in range(2)]
        out.append((d, len(both), means[1] - means[0] if both else None, means[1], means[0]))
    return out


def corpus():
    rng = random.Random(5)
    often, seldom = "the of É and Ünd is a b c d".split(), [f"w{i}" for i in range(300)]
    say = lambda: " ".join(rng.choice(often if rng.random() < 0.6 else seldom) for _ in range(rng.randint(0, 40)))
    rows = [(i, say()) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, "one"), (203, "The the " * 3000), (4, rows[4][1]), (None, "a b c"), (204, " -- ")]


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[:2]), r[3] or 0)) for x in (map(tuple, got), want))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g[2:], w[2:], strict=True):
            assert x == (y if y is None else pytest.approx(y, abs=1e-6))


# Shares at which all words are frequent, none is, and some are; with one bucket and with many.
@pytest.mark.parametrize("frequent, hot, pairs, bucket", [(17, 1 << 11, 1 << 16, 1 << 20), (5, 16, 64, 100), (3, 8, 16, 50), (17, 1, 1, 500)])
def test_scores_equal_brute_force(spark, monkeypatch, frequent, hot, pairs, bucket):
    for name, value in (("FREQUENT", 1 << frequent), ("HOT", hot), ("HOT_PAIRS", pairs), ("BUCKET", bucket)):
        monkeypatch.setattr(L, name, value)
    rows = corpus()
    labels = [(i, int(i % 3 == 0), int(i % 6 == 0)) for i in range(60)] + [(1, None, 0), (None, 1, 0), (3, 0, 0)]
    good = {d for d, q, t in labels if q == 1 and t == 0 and d is not None}
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, loss_difference double").repartition(3)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    same(L.score(docs, frame).collect(), brute(rows, good))
    if bucket == 100:
        monkeypatch.setattr(L, "MARKS", 3)  # more targets than may be sent
        same(L.score(docs, frame).collect(), brute(rows, good))


def test_no_targets_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert L.score(docs, labels).first().loss_difference > 0
    same(L.score(docs, labels).collect(), brute([(1, "a b a b")], set()))
    assert L.score(docs.where("false"), labels).count() == 0


def test_rare_words_with_one_ending_are_told_apart(spark):
    say = lambda kind: [f"{kind}{i}ing" for i in range(2000)]
    cut = lambda w, n: [" ".join(w[i::n]) for i in range(n)]
    rows = list(enumerate(cut(say("good"), 20) * 2 + cut(say("poor"), 20) * 2 + ["the of " * 500]))
    good = set(range(20))
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels).collect()
    same(got, brute(rows, good))
    found = {r.doc_id: r.loss_difference for r in got}
    assert max(found[d] for d in range(40)) < min(found[d] for d in range(40, 80))


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(2)
    say = lambda: " ".join(f"w{rng.randint(0, 900)}" for _ in range(80))
    once, twice = [(i, say()) for i in range(60)], [(100 + i, say()) for i in range(10)]
    rows = once + twice + [(d + 100, t) for d, t in twice]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.background_loss for r in L.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert max(x for d, x in got.items() if d >= 100) < min(x for d, x in got.items() if 1 < d < 100)
