import random

import numpy as np
import pytest

from spanloom.llm import mixing as M

RNG = random.Random(9)
WORDS = {d: [f"{d}{i}" for i in range(80)] for d in ("en", "de", "fr")}


def text(d):
    other = RNG.choice(list(WORDS))
    share = RNG.choice([0, 0, 0.4])
    return " ".join(RNG.choice(WORDS[other if RNG.random() < share else d]) for _ in range(RNG.randint(10, 60)))


def tables(spark):
    kinds = [RNG.choice(["en", "en", "en", "de", "fr"]) for _ in range(700)]
    rows = [(i, text(k), k, 1.0) for i, k in enumerate(kinds)] + [(900, None, "x", 1.0), (901, "", "x", 2.0), (901, "", "x", 2.0), (None, "en1 en2 en3", "x", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate double").repartition(3)
    labelled = spark.createDataFrame([(i, k) for i, k in enumerate(kinds[:400])] + [(401, None), (None, "en"), (402, "zz")], "doc_id long, domain string")
    return docs, labelled, kinds


def test_expected_tokens_meet_the_targets(spark):
    docs, labelled, kinds = tables(spark)
    targets = {"en": 0.3, "de": 0.3, "fr": 0.4}
    got = M.mix(docs, labelled, targets).collect()
    assert len(got) == 704
    total = sum(r.n_tokens for r in got)
    for d, share in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - share) < 0.005
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 700]
    right = sum(max(targets, key=lambda d: r[f"p_{d}"]) == kinds[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)


def test_rates_equal_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 50, 200)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(200)], "doc_id long, n_tokens long, p array<double>").repartition(4)
    targets = np.array([0.7, 0.25, 0.05])
    w = M.rates(p, M.solve(members, targets))[0]
    share = n @ p
    x = np.ones(200)
    for _ in range(20000):  # plain projected gradient
        q = ((x * n) @ p - targets * n.sum()) / share
        x = np.maximum(0, x - 0.5 * (p @ q + M.RIDGE * (x - 1)))
    cost = lambda y: (((y * n) @ p - targets * n.sum()) ** 2 / share).sum() / n.sum() + M.RIDGE * (n * (y - 1) ** 2).sum() / n.sum()
    assert cost(w) <= cost(x) + 1e-5 and np.abs(w - x).max() < 0.2


def test_documents_with_their_rates(spark):
    docs, labelled, _ = tables(spark)
    targets = {"en": 0.3, "de": 0.3, "fr": 0.4}
    key = lambda r: (str(r.doc_id), round(r.rate, 9), r.copies, r.n_tokens, round(r.p_en, 9))
    got = M.weigh(docs, labelled, targets)
    assert got.columns == ["doc_id", "text", "lang", "n_tokens", "p_en", "p_de", "p_fr", "rate", "copies"]  # its own rate is replaced
    assert sorted(map(key, got.collect())) == sorted(map(key, M.mix(docs, labelled, targets).collect()))
    assert M.weigh(docs.where("false"), labelled, targets).count() == 0


def test_rounds_that_do_not_end_are_reported(spark):
    members = spark.createDataFrame([(1, 10, [0.9, 0.1]), (2, 10, [0.8, 0.2])], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="away from its target"):
        M.solve(members, np.array([0.05, 0.95]), rounds=2)


def test_odd_tables(spark):
    docs, labelled, _ = tables(spark)
    assert M.mix(docs.where("false"), labelled, {"en": 1.0}).count() == 0
    rows = M.mix(docs.limit(5), labelled.where("false"), {"en": 0.5, "de": 0.5}).collect()
    assert len(rows) == 5 and all(abs(r.rate - 1) < 0.01 and r.p_en == 0.5 for r in rows)
    assert all(r.rate == 1 for r in M.mix(docs.where("doc_id >= 900"), labelled, {"en": 1.0, "de": 1.0}).collect())
