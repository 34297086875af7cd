"""Document quality by hierarchical empirical Bayes.

A classifier gives each text log-likelihood ratios of being low-quality, and of being toxic, against
being good (see :mod:`spanloom.llm.classifier`).  The evidence is combined with where a document comes from: grouped
aggregation gives the mean evidence of each host and of each path of a host; a host is shrunk
towards the global rate and a path towards its host, with weights fitted by moments from the spread
between sites, so sparse sites stay near their parent.  A document's posterior odds are its
likelihood ratio times the odds of its path as the other documents there give them: its own evidence is
taken out of the rates that it meets, so that it counts once.

Labelled documents that are used are bounded by ``SAMPLE_ROWS``, those with the smallest hash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.llm.classifier import Classifier, fit
from spanloom.llm.selecting import BROADCAST_KEYS
from spanloom.session import Workspace

SAMPLE_ROWS = 20_000
#: Posterior under which a document is rejected.
KEEP = 0.5
#: Weight of a site's parent, in documents, where the spread between sites gives none.
MOST_WEIGHT = 1e6

CLASSES = ("good", "low", "toxic")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents; labels with a null are not used.

    A document that has several labels counts as bad if any says so.  Without labelled documents all
    ratios are 0 and every document counts as good.
    """
    marked = labels.where(f"{key} is not null and quality is not null and toxic is not null")
    marked = marked.groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marked = marked.select(key, F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("_class"))
    return fit(docs, marked, len(CLASSES), key, text, rows)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sites(evidence: DataFrame, rate: float) -> DataFrame:
    """(host, path, host_rate, path_rate): shares of good documents, shrunk towards the parent, with the sums and weights behind them."""
    paths = evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))

    def weight(rows: DataFrame, s: str, n: str, parent: Column) -> Column:
        # Beta-binomial by moments: spread between sites beyond what chance gives.
        got = rows.select(F.col(s).alias("s"), F.col(n).alias("n"), parent.alias("m")).agg(
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("between"),
            F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
            F.sum("n").alias("n"),
            F.count("*").alias("k"),
            F.avg(F.col("m") * (1 - F.col("m"))).alias("v"),
        ).first()
        if not got.k or got.k < 2 or not got.n:
            return F.lit(MOST_WEIGHT)
        extra = (got.between - got.chance) / got.n
        return F.lit(float(min(MOST_WEIGHT, max(1.0, got.v / extra - 1))) if extra > 0 else MOST_WEIGHT)

    kappa = weight(hosts, "hs", "hn", F.lit(rate))
    shrunk = hosts.select(F.col("host").alias("_h"), "hs", "hn", _shrunk(F.col("hs"), F.col("hn"), kappa, F.lit(rate)).alias("host_rate"))
    both = paths.join(shrunk, F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", "s", "n", "hs", "hn", "host_rate")
    own = weight(both, "s", "n", F.col("host_rate"))
    return both.withColumns({"path_rate": _shrunk(F.col("s"), F.col("n"), own, F.col("host_rate")), "host_weight": kappa, "path_weight": own})


def _shrunk(s: Column, n: Column, weight: Column, parent: Column) -> Column:
    return (s + weight * parent) / (n + weight)


class Model:
    """A trained classifier and, once fitted, the rates of sites."""

    def __init__(self, docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text"):
        self.session, self.text, self.key, self.host, self.path = docs.sparkSession, text, key, host, path
        self.classifier = train(docs, labels, key, text)
        # Without labels nothing speaks against any document.
        self.prior = self.classifier.prior if self.classifier.rows else [0.98, 0.01, 0.01]
        self.sent = self.session.sparkContext.broadcast(self.classifier)

    def _scored(self, docs: DataFrame) -> DataFrame:
        """The input's columns, ``_low`` and ``_toxic``: log-likelihood ratios against good."""
        sent, text = self.sent, self.text

        def run(batches):
            for batch in W.pieces(batches, text):
                low, toxic = sent.value.ratios(batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(toxic)], [*batch.schema.names, "_low", "_toxic"])

        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{own}, _low double, _toxic double")

    def _against(self) -> Column:
        """Log-likelihood ratio of good against the mixture of the other classes."""
        prior = self.prior
        low, toxic = (float(prior[k] / (prior[1] + prior[2])) for k in (1, 2))
        return -F.log(low * F.exp(F.col("_low")) + toxic * F.exp(F.col("_toxic")))

    def fit(self, docs: DataFrame, work: Workspace) -> DataFrame:
        """Score every document, save the scores, and save what the sites give."""
        slim = docs.select(F.col(self.key), F.col(self.text), self.host.alias("host"), self.path.alias("path"))
        rate = float(self.prior[0])
        scored = self._scored(slim).select(self.key, "host", "path", self._against().alias("ratio"))
        scored = work.save(scored, "scores")
        odds = F.col("ratio") + _logit(F.lit(rate))
        self.sites = work.save(_sites(scored.withColumn("p", 1 / (1 + F.exp(-odds))), rate), "sites")
        return scored

    def joined(self, scored: DataFrame) -> DataFrame:
        """With ``host_rate``, ``path_rate``, both without the document itself, and ``posterior``.

        Sites are broadcast after they are counted; where they are too many, Spark shuffles and splits hot ones.
        """
        names = ["s", "n", "hs", "hn", "host_weight", "path_weight"]
        sites = self.sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.struct(*names).alias("_site"))
        if self.sites.count() <= BROADCAST_KEYS // 16:
            sites = F.broadcast(sites)
        same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
        rate = float(self.prior[0])
        own = 1 / (1 + F.exp(-(F.col("ratio") + _logit(F.lit(rate)))))
        site = {k: F.col(f"_site.{k}") for k in names}
        # A sum from which its only member is taken must not fall below 0 by rounding.
        without = lambda s, n, weight, parent: _shrunk(F.greatest(site[s] - own, F.lit(0.0)), site[n] - 1, site[weight], parent)
        both = scored.join(sites, same).withColumn("host_rate", without("hs", "hn", "host_weight", F.lit(rate)))
        both = both.withColumn("path_rate", without("s", "n", "path_weight", F.col("host_rate")))
        odds = F.col("ratio") + _logit(F.col("path_rate"))
        return both.withColumn("posterior", 1 / (1 + F.exp(-odds))).drop("_host", "_path", "_site")


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, evidence, host_rate, path_rate, posterior, keep.

    A null or empty text has no words and is judged by its style and site.  Null hosts and paths are
    sites of their own.  Repeated rows give repeated results.  Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "quality")
    model = Model(docs, labels, host, path, key, text)
    out = model.joined(model.fit(docs, work))
    return out.select(
        key, F.col("ratio").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= KEEP).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose posterior is at least ``KEEP``, with their columns.

    Texts are scored again where they stand instead of being shuffled to the decisions.
    """
    work = Workspace(docs.sparkSession, "quality")
    model = Model(docs, labels, host, path, key, text)
    model.fit(docs, work)
    names = docs.columns
    # Names of the method's own columns cannot clash: the row travels as one struct.
    packed = docs.select(F.struct(*names).alias("_row"), F.col(text).alias(text), host.alias("host"), path.alias("path"))
    scored = model._scored(packed).select("_row", "host", "path", model._against().alias("ratio"))
    return model.joined(scored).where(F.col("posterior") >= KEEP).select("_row.*")
