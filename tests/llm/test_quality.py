import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality as Q

RNG = random.Random(3)
GOOD = [f"word{i}" for i in range(300)]


def text(kind):
    words = [RNG.choice(GOOD) for _ in range(RNG.randint(20, 80))]
    if kind == "toxic":
        for _ in range(4):
            words.insert(RNG.randrange(len(words)), RNG.choice(["vile", "rotten", "dumb"]))
    if kind == "low":
        words = [w + RNG.choice(["%%%", "$$$", "|"]) for w in words]
    return " ".join(words)


def corpus(n):
    kinds = [RNG.choice(["good", "good", "good", "low", "toxic"]) for _ in range(n)]
    return [(i, text(k), f"host{i % 3 if i % 2 else 0}", RNG.choice(["a", "b"]), k) for i, k in enumerate(kinds)]


@pytest.fixture(scope="module")
def rows():
    return corpus(900)


def tables(spark, rows):
    docs = spark.createDataFrame([(*r[:4], 1.5) for r in rows], "doc_id long, text string, host string, path string, posterior double")
    labels = spark.createDataFrame([(r[0], int(r[4] != "low"), int(r[4] == "toxic")) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int")
    return docs.repartition(3), labels


def test_held_out_accuracy(spark, rows):
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in Q.posteriors(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] >= 500]
    right = sum(got[r[0]].keep == (r[4] == "good") for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.posterior <= 1 for r in got.values())


def test_sparse_sites_shrink_towards_their_parent(spark):
    rows = [("big", "x", 0.9)] * 400 + [("bad", "x", 0.1)] * 400 + [("bad", "y", 0.95)] + [("new", "z", 0.0)] + [(None, None, 0.5)]
    got = {(r.host, r.path): r for r in Q._sites(spark.createDataFrame(rows, "host string, path string, p double"), 0.6).collect()}
    assert len(got) == 5
    assert abs(got["big", "x"].path_rate - 0.9) < 0.02 and abs(got["bad", "x"].path_rate - 0.1) < 0.02
    assert got["bad", "y"].path_rate < 0.6  # one document moves it little from its host
    assert 0.0 < got["new", "z"].path_rate <= 0.6


def test_filter_keeps_columns_and_bears_odd_rows(spark, rows):
    odd = [(9000, None, None, None, 1.0), (9001, "", "host0", "a", None), (9001, "", "host0", "a", None), (None, "word1 word2", "host1", "b", 0.0), (9002, "word1 " * 20000, "host0", "a", 0.1)]
    docs, labels = tables(spark, rows)
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    labels = labels.union(spark.createDataFrame([(1, None, 0), (None, 1, 1)], labels.schema))
    kept = Q.keep_good(docs, labels, F.col("host"), F.col("path"))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    good = {r[0] for r in rows if r[4] == "good"}
    assert len(good - set(ids)) <= 0.03 * len(good)
    assert Q.posteriors(docs, labels, F.col("host"), F.col("path")).count() == docs.count()
    assert Q.posteriors(docs.where("false"), labels, F.col("host"), F.col("path")).count() == 0
    assert Q.keep_good(docs, labels.where("false"), F.col("host"), F.col("path")).count() == docs.count()


def test_posteriors_equal_brute_force(spark, rows):
    docs, labels = tables(spark, rows)
    extra = [(9000, None, None, None, 1.0), (9001, "word1", "alone", "z", 1.0), (9001, "word1", "alone", "z", 1.0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = Q.posteriors(docs, labels, F.col("host"), F.col("path")).collect()
    site = {r.doc_id: (r.host, r.path) for r in docs.collect()}
    rate = float(Q.train(docs, labels).prior[0])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    good = lambda x: 1 / (1 + math.exp(-x))
    seen = [(*site[r.doc_id], good(r.evidence + logit(rate))) for r in got]

    def weight(groups):  # of (sum, number, parent's rate)
        n = sum(g[1] for g in groups)
        between = sum(k * (s / k - m) ** 2 for s, k, m in groups)
        chance = sum(m * (1 - m) for _, _, m in groups)
        extra = (between - chance) / n
        return min(Q.MOST_WEIGHT, max(1.0, chance / len(groups) / extra - 1)) if extra > 0 else Q.MOST_WEIGHT

    def sums(key):
        out = {}
        for h, p, x in seen:
            s, n = out.get(key(h, p), (0.0, 0))
            out[key(h, p)] = s + x, n + 1
        return out

    hosts, paths = sums(lambda h, p: h), sums(lambda h, p: (h, p))
    kappa = weight([(*x, rate) for x in hosts.values()])
    own = weight([(*x, (hosts[h][0] + kappa * rate) / (hosts[h][1] + kappa)) for (h, p), x in paths.items()])
    for r, (h, p, x) in zip(got, seen, strict=True):
        host = (max(hosts[h][0] - x, 0) + kappa * rate) / (hosts[h][1] - 1 + kappa)
        path = (max(paths[h, p][0] - x, 0) + own * host) / (paths[h, p][1] - 1 + own)
        assert (r.host_rate, r.path_rate) == (pytest.approx(host), pytest.approx(path))
        assert r.posterior == pytest.approx(good(r.evidence + logit(path))) and r.keep == (r.posterior >= Q.KEEP)
