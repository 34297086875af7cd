"""Mixing a corpus to target weights by soft membership.

A classifier fitted on a labelled table predicts for every document the posterior of each domain.
Rates ``w >= 0``, one a document, are chosen so that the expected tokens of each domain match a share
of the budget: with tokens ``n``, posteriors ``p`` and targets ``T`` they minimise

    sum_k (sum_i w_i n_i p_ik - T_k)^2 / (2 N^2 s_k)  +  RIDGE/2 sum_i (n_i / N) (w_i - 1)^2

where ``N`` are all tokens and ``s_k`` the domain's share of them.  In the metric of the ridge term a
step of projected gradient is ``w <- max(0, w - step * (p . q + RIDGE (w - 1)))`` with
``q_k = (sum_i w_i n_i p_ik - T_k) / (N s_k)``, and a step of ``1 / (1 + RIDGE)`` never overshoots.  A
round is one pass over the saved memberships that sums a few numbers per task; a document's rate is
rebuilt in the task from the rounds' vectors ``q``, so no table of rates is written or shuffled.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.classifier import fit
from spanloom.session import Workspace

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
RIDGE = 1e-3
ROUNDS, TOLERANCE, CLOSE = 60, 1e-4, 1e-2


def rates(posteriors: np.ndarray, history: list[np.ndarray], ridge: float = RIDGE) -> np.ndarray:
    """Rates after the rounds in ``history``, with Nesterov's momentum; ``posteriors`` is (texts, domains)."""
    w = ahead = np.ones(len(posteriors))
    t = 1.0
    step = 1 / (1 + ridge)
    for q in history:
        after = np.maximum(0.0, ahead - step * (posteriors @ q + ridge * (ahead - 1)))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / u * (after - w)
        w, t = after, u
    return w, ahead


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str) -> DataFrame:
    """(doc_id, n_tokens, p): tokens and posteriors of the domains, in the order given.

    ``labelled`` has the key and ``domain``; a document with several domains counts for the first by
    name, one with a null or another domain for none.
    """
    sent = _classifier(docs, labelled, domains, key, text)
    return _members(docs, sent, key, text)


def _classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str):
    number = F.coalesce(*(F.when(F.col("domain") == d, F.lit(k)) for k, d in enumerate(domains)))
    marked = labelled.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("domain").alias("domain"))
    marked = marked.select(key, number.alias("_class")).where("_class is not null")
    return docs.sparkSession.sparkContext.broadcast(fit(docs, marked, len(domains), key, text, SAMPLE_ROWS))


def _members(docs: DataFrame, sent, key: str, text: str) -> DataFrame:
    def run(batches):
        for batch in W.pieces(batches, text):
            p = sent.value.posteriors(batch.column(text)).T
            edges = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(p.reshape(-1)))
            n = W.split(batch.column(text), W.ALPHANUMERIC).per_doc
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n), lists], ["doc_id", "n_tokens", "p"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>")


def solve(members: DataFrame, targets: np.ndarray, budget: float | None = None, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The vectors ``q`` of all rounds; ``targets`` are shares of the budget, all tokens by default.

    Rounds end when ``q`` stands still.  Where they run out before, the rates are feasible and as near as
    they came, and a warning says how far they are from the targets if that is ``CLOSE`` or more.
    """
    k = len(targets)

    def totals(history):
        def run(batches):
            plain, now = np.zeros(k), np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    p, n = _matrix(batch, k), batch.column("n_tokens").to_numpy()
                    plain += n @ p
                    now += (rates(p, history)[1] * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(plain), pa.array(now)], ["k", "plain", "now"])

        got = members.mapInArrow(run, "k long, plain double, now double").groupBy("k").agg(F.sum("plain"), F.sum("now")).collect()
        out = np.zeros((2, k))
        for row in got:
            out[:, row[0]] = row[1:]
        return out

    history: list[np.ndarray] = []
    for _ in range(rounds):
        plain, now = totals(history)
        total = plain.sum()
        if not total:
            return []
        wanted = np.asarray(targets) / np.sum(targets) * (total if budget is None else budget)
        q = (now - wanted) / np.maximum(plain, 1e-9 * total)
        if history and np.abs(q - history[-1]).max() < TOLERANCE:
            return history
        history.append(q)
    if np.abs(q).max() >= CLOSE:
        warnings.warn(f"mixing ended after {rounds} rounds, {np.abs(q).max():.2g} of a domain away from its target", stacklevel=2)
    return history


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", budget: float | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p_<domain> for each, rate, copies.

    ``rate`` is how often the document should be read; ``copies`` rounds it up or down by a hash of the
    id, so that its mean is the rate.  Targets of domains that no document belongs to cannot be met;
    the rates then come as near as they can.  Null and empty texts have no tokens.  Repeated rows are
    documents of their own.  Without labelled rows all domains are as likely.  Other columns are not
    read.  The sum of targets must not be 0.
    """
    domains = list(targets)
    work = Workspace(docs.sparkSession, "mixing")
    members = work.save(memberships(docs, labelled, domains, key, text), "members")
    history = solve(members, np.array([targets[d] for d in domains], float), budget)
    k = len(domains)

    def run(batches):
        for batch in batches:
            p = _matrix(batch, k) if batch.num_rows else np.zeros((0, k))
            rate = pa.array(rates(p, history)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, rate], [*batch.schema.names, "rate"])

    kind = dict(members.dtypes)["doc_id"]
    rated = members.mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>, rate double")
    return rated.select(
        F.col("doc_id").alias(key),
        "n_tokens",
        *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)),
        "rate",
        _copies("doc_id").alias("copies"),
    )


def _copies(key: str) -> Column:
    part = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")).cast("long")


def weigh(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", budget: float | None = None
) -> DataFrame:
    """``docs`` with their columns and those of :func:`mix`: n_tokens, p_<domain>, rate and copies.

    Columns of ``docs`` with these names are replaced.  Memberships are computed again where the texts
    stand, so that no text is shuffled.
    """
    domains = list(targets)
    sent = _classifier(docs, labelled, domains, key, text)
    members = Workspace(docs.sparkSession, "mixing").save(_members(docs, sent, key, text), "members")
    history = solve(members, np.array([targets[d] for d in domains], float), budget)
    made = ["n_tokens", *(f"p_{d}" for d in domains), "rate"]
    names = [c for c in docs.columns if c not in (*made, "copies")]

    def run(batches):
        for batch in W.pieces(batches, text):
            p = sent.value.posteriors(batch.column(text)).T
            n = W.split(batch.column(text), W.ALPHANUMERIC).per_doc
            columns = [n, *p.T, rates(p, history)[0]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, columns)], [*names, *made])

    own = docs.select(*dict.fromkeys([*names, text]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    fields += ["`n_tokens` long", *(f"`{c}` double" for c in made[1:])]
    return own.mapInArrow(run, ", ".join(fields)).withColumn("copies", _copies(key))
