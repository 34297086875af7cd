"""Distances between a reference and a current distribution.

Inputs are long tables (side, feature, v) with side ``ref`` or ``cur``; one job serves all features.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-10
PSI_BINS = 10


#: Slices of a feature's range, by value, within which running totals are taken apart from each other.
SLICES = 1024


def running(counts: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, v, ...) with ``upto_`` running totals of ``columns`` by v, each v once a feature.

    A feature's range is cut into slices, so that its values are sorted by many tasks; the totals of the
    slices before come from a table of one row a slice.
    """
    edge = counts.groupBy("feature").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    place = (F.col("v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    slot = F.when(F.isnan(place), SLICES).otherwise(F.floor(place * SLICES)).cast("int")
    cut = counts.join(F.broadcast(edge), "feature").withColumn("_slot", slot).drop("_lo", "_hi")
    before = Window.partitionBy("feature").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("feature", "_slot").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    totals = totals.select("feature", "_slot", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    within = Window.partitionBy("feature", "_slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(totals), ["feature", "_slot"])
    return out.withColumns({f"upto_{c}": F.col(f"_{c}") + F.sum(c).over(within) for c in columns}).drop("_slot", *(f"_{c}" for c in columns))


def psi_reference(values: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, edges, expected) of (feature, v): a table to be stored, against which later values are held.

    The inner edges are the values at places floor(i / bins * (n - 1)) of the sorted reference; a bin
    holds its lower edge, and a value outside belongs to the first or last bin.
    """
    # Equal values are counted first, so only distinct ones are sorted.
    counts = values.where("v is not null").groupBy("feature", "v").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("feature").agg(F.sum("k").alias("n"))
    placed = running(counts, ["k"]).withColumnRenamed("upto_k", "after").join(F.broadcast(sizes), "feature")
    wanted = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.floor(i / bins * (F.col("n") - 1)))
    hit = F.size(F.filter(wanted, lambda w: (w >= F.col("after") - F.col("k")) & (w < F.col("after"))))
    # Only values at a wanted place are collected, nine a feature.
    edges = placed.withColumn("_hit", hit).where("_hit > 0").groupBy("feature").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("v", F.col("_hit"))))).alias("edges"))
    return _binned(values, edges).select("feature", "edges", F.col("counts").alias("expected"))


def _binned(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, edges, counts): how many values lie in each bin."""
    # How many inner edges a value has reached is its bin.
    binned = values.where("v is not null").join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
    counts = binned.groupBy("feature", "bin").agg(F.count("*").alias("k")).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return edges.join(counts, "feature", "left").select("feature", "edges", each.alias("counts"))


def psi_against(reference: DataFrame, values: DataFrame) -> DataFrame:
    """Population stability index of (feature, v) against a stored :func:`psi_reference`."""
    now = _binned(values, reference.select("feature", "edges")).select("feature", "counts")
    both = reference.join(now, "feature")
    share = lambda c: (lambda whole: F.transform(c, lambda k: F.greatest(k / whole, F.lit(EPSILON))))(F.aggregate(c, F.lit(0).cast("long"), lambda s, k: s + k))
    parts = F.zip_with(share("expected"), share("counts"), lambda e, a: (a - e) * F.log(a / e))
    out = both.select("feature", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("s"))
    label = F.when(F.col("s") < 0.1, "none").when(F.col("s") < 0.25, "moderate").otherwise("significant")
    return out.select("feature", F.round("s", 8).alias("psi"), (F.col("s") >= 0.2).alias("drift"), label.alias("label"))


def psi(rows: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index of each feature over bins at the reference's order statistics."""
    side = lambda name: rows.where(F.col("side") == name).select("feature", "v")
    return psi_against(psi_reference(side("ref"), bins), side("cur"))


def ks(rows: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each feature, with an asymptotic p-value."""
    by_value = rows.groupBy("feature", "v").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    whole = by_value.groupBy("feature").agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    steps = running(by_value, ["r", "c"]).join(whole, "feature")
    d = steps.groupBy("feature").agg(F.max(F.abs(F.col("upto_r") / F.col("n") - F.col("upto_c") / F.col("m"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    z = (root + 0.12 + 0.11 / root) * F.col("d")
    p = F.least(2 * F.exp(-2 * z * z), F.lit(1.0))
    return d.select("feature", F.round("d", 8).alias("ks"), F.round(p, 8).alias("p_value"), (F.col("d") > 0.1).alias("drift"), (p < 0.05).alias("significant"))


def class_counts(rows: DataFrame) -> DataFrame:
    """(class, p, q): shares of each class in reference and current; a missing class has 0."""
    counts = rows.groupBy("class").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    totals = counts.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    return counts.join(F.broadcast(totals)).select("class", "r", "c", (F.col("r") / F.col("tr")).alias("p"), (F.col("c") / F.col("tc")).alias("q"), "tr", "tc")


def jensen_shannon(rows: DataFrame) -> DataFrame:
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log((F.col(x) + EPSILON) / (m + EPSILON))).otherwise(0.0))
    return class_counts(rows).agg(F.round((kl("p") + kl("q")) / 2, 8).alias("js"), F.count_if((F.col("r") == 0) & (F.col("c") > 0)).alias("new_classes"))


def top_changed(rows: DataFrame, k: int = 5) -> DataFrame:
    return class_counts(rows).select("class", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"), F.round(F.abs(F.col("q") - F.col("p")), 8).alias("change")).orderBy(F.desc("change"), "class").limit(k)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a polynomial that is right to seven digits."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = reduce(lambda sum_, c: (sum_ + c) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
    upper = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi_square_p(chi2: Column, df: Column) -> Column:
    """P-value by the cube root's approximate normality; 1 without freedom or difference."""
    v = 2.0 / (9.0 * df)
    return F.when((df <= 0) | (chi2 <= 0), 1.0).otherwise(normal_tail((F.pow(chi2 / df, F.lit(1.0 / 3.0)) - (1 - v)) / F.sqrt(v)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs by its t statistic, taken as normal; 1 for under three pairs."""
    t = F.abs(r) * F.sqrt(F.greatest(n - 2, F.lit(0)) / F.greatest(1 - r * r, F.lit(EPSILON)))
    return F.when(n < 3, 1.0).otherwise(2 * normal_tail(t))


def chi_square(rows: DataFrame, least: float = 5.0) -> DataFrame:
    """Sum of (o - e)^2 / e over classes whose expected count is above ``least``."""
    expected = F.col("p") * F.col("tc")
    rows = class_counts(rows).withColumn("e", expected).where(F.col("e") > least)
    return rows.agg(F.round(F.sum(F.pow(F.col("c") - F.col("e"), 2) / F.col("e")), 6).alias("chi2"), (F.count("*") - 1).alias("df"))


def chi_square_test(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """:func:`chi_square` with its p-value and decision."""
    p = chi_square_p(F.col("chi2"), F.col("df"))
    return chi_square(rows).select("chi2", "df", F.round(p, 6).alias("p_value"), (p < level).alias("drift"))


def by_model(reference: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(model_id, x) of two windows side by side: sizes, means, and the shift in the reference's deviations."""
    stats = lambda rows, p: rows.groupBy("model_id").agg(F.count("x").alias(f"{p}_n"), F.avg("x").alias(f"{p}_mean"), F.stddev_samp("x").alias(f"{p}_sd"))
    both = stats(reference, "ref").join(stats(current, "cur"), "model_id", "full")
    shift = F.try_divide(F.abs(F.col("cur_mean") - F.col("ref_mean")), F.col("ref_sd"))
    return both.select("model_id", F.coalesce("ref_n", F.lit(0)).alias("ref_n"), F.coalesce("cur_n", F.lit(0)).alias("cur_n"), F.round(shift, 8).alias("shift"), F.coalesce(shift > threshold, F.lit(False)).alias("drift"))


def drift_trend(alerts: DataFrame, hours: int) -> DataFrame:
    """Mean score of each drift type by interval and how it moves against the interval before."""
    at = F.floor(F.unix_seconds(F.col("detected_at").cast("timestamp")) / (hours * 3600))
    rows = alerts.groupBy("drift_type", at.alias("slot")).agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    move = F.col("s") - F.lag("s").over(Window.partitionBy("drift_type").orderBy("slot"))
    trend = F.when(move > 0.01, "up").when(move < -0.01, "down").otherwise("flat")
    return rows.withColumn("trend", trend).select("drift_type", "slot", "n", F.round("s", 8).alias("score"), "trend")


def feature_stats(rows: DataFrame) -> DataFrame:
    return rows.where("side = 'ref'").groupBy("feature").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")
    )


def welch(rows: DataFrame) -> DataFrame:
    """|mean difference| over its standard error; 0 where that is under 1e-10."""
    on = lambda f, side: f(F.when(F.col("side") == side, F.col("v")))
    s = rows.groupBy("feature").agg(
        *(on(f, side).alias(f"{name}_{side}") for side in ("ref", "cur") for name, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count)))
    )
    se = F.sqrt(F.col("s_ref") / F.col("n_ref") + F.col("s_cur") / F.col("n_cur"))
    return s.select("feature", F.round(F.when(se < 1e-10, 0.0).otherwise(F.abs(F.col("m_ref") - F.col("m_cur")) / se), 6).alias("t"))


def text_length_drift(rows: DataFrame) -> DataFrame:
    """Change of mean length in bytes, in reference standard deviations; rows have side and text."""
    n = F.octet_length("text")
    on = lambda f, side: f(F.when(F.col("side") == side, n))
    s = rows.agg(on(F.avg, "ref").alias("a"), on(F.avg, "cur").alias("b"), on(F.stddev_pop, "ref").alias("sd"))
    score = F.abs(F.col("b") - F.col("a")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.col("a") + 1)
    return s.select(F.round(score, 8).alias("score"), (score > 0.1).alias("drift"))


def equal_width(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Normalised histogram of each feature; the last bin holds the maximum, a constant has one bin."""
    edge = rows.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.join(F.broadcast(edge), "feature").groupBy("feature", place.cast("long").alias("bin"), "n").agg(F.count("*").alias("c")).select(
        "feature", "bin", F.round(F.col("c") / F.col("n"), 8).alias("share")
    )


def centroids(vectors: DataFrame, keys: list[str], unit: bool = False) -> DataFrame:
    """(keys, centroid): mean vector by key, by position; with ``unit`` of vectors scaled to length 1."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    if unit:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform(v, lambda x: x / norm)
    means = vectors.select(*keys, F.posexplode(v).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _sides(vectors: DataFrame, unit: bool) -> DataFrame:
    c = centroids(vectors, ["side"], unit)
    one = lambda side: c.where(F.col("side") == side).select(F.col("centroid").alias(side))
    return one("ref").join(F.broadcast(one("cur")))


def centroid_drift(vectors: DataFrame) -> DataFrame:
    return _sides(vectors, False).select(F.round(1 - cosine(F.col("ref"), F.col("cur")), 6).alias("score"))


def mean_cosine_drift(vectors: DataFrame) -> DataFrame:
    """1 - mean cosine of all current with all reference vectors: the dot of the mean unit vectors."""
    score = F.least(F.greatest(1 - dot(F.col("ref"), F.col("cur")), F.lit(0.0)), F.lit(1.0))
    return _sides(vectors, True).select(F.round(score, 6).alias("score"), (score > 0.1).alias("drift"))


#: Blocks of a key, in each of which a row stands once.
MOST_BLOCKS = 24


def mmd(groups: DataFrame, permutations: int = 100, seed: int = 7, block: int = 512) -> DataFrame:
    """Unbiased squared MMD of each key with an RBF kernel of median bandwidth, and a permutation test.

    ``groups`` has key, side, id (different within a key) and embedding; all rows count.  The kernel is
    computed in pairs of blocks, ``MOST_BLOCKS`` at most, in parts of about ``block`` rows, each pair by one task, for all permutations at once: a
    permutation is a 0/1 column that says which rows stand for the reference, as many as there are.
    The bandwidth is the median distance within the first 100 rows of a key, the reference's first.
    """
    rows = groups.where("id is not null and embedding is not null").select("key", "id", (F.col("side") == "ref").alias("ref"), "embedding")
    sizes = rows.groupBy("key").agg(F.count_if("ref").alias("m"), F.count_if(~F.col("ref")).alias("n"))

    def width(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("k")["embedding"].to_numpy()).astype(float)
        squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)[np.triu_indices(len(x), 1)]
        sigma = max(float(np.sqrt(np.median(squared))) / np.sqrt(2 * np.log(2)), 0.01) if len(squared) else 1.0
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "sigma": [sigma]})

    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ref"), "id"))).where("k <= 100")
    widths = first.groupBy("key").applyInPandas(width, "key string, sigma double")
    # The m rows of smallest hash stand for the reference; permutation 0 is what was seen.
    drawn = rows.select("key", "id").join(F.broadcast(sizes), "key").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    place = F.row_number().over(Window.partitionBy("key", "r").orderBy(F.xxhash64("id", F.lit(seed), "r"), "id"))
    drawn = drawn.withColumn("label", (place <= F.col("m")).cast("tinyint")).groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("drawn"))
    marked = rows.join(drawn, ["key", "id"]).join(F.broadcast(sizes), "key").join(F.broadcast(widths), "key")
    # Every row is sent to each block: their number is bounded, and larger blocks are compared in parts.
    blocks = F.least(F.ceil((F.col("m") + F.col("n")) / block), F.lit(MOST_BLOCKS)).cast("int")
    marked = marked.select(
        "key",
        "sigma",
        F.concat(F.array(F.col("ref").cast("tinyint")), F.transform("drawn", lambda x: x["label"])).alias("labels"),
        F.col("embedding").alias("x"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        sides = [frame[frame["block"] == b] for b in (low, high)]
        if not all(len(s) for s in sides):
            return pd.DataFrame(columns=["key", "r", "inner", "one", "all"])
        (x, a), (y, b) = ((np.stack(s["x"].to_numpy()).astype(float), np.stack(s["labels"].to_numpy()).astype(float)) for s in sides)
        inner, left, right, total = 0.0, 0.0, 0.0, 0.0
        for k in range(0, len(x), block):
            for h in range(0, len(y), block):
                p, q = slice(k, k + block), slice(h, h + block)
                squared = np.maximum((x[p] * x[p]).sum(1)[:, None] + (y[q] * y[q]).sum(1)[None, :] - 2 * x[p] @ y[q].T, 0)
                kernel = np.exp(-squared / (2 * frame["sigma"].iloc[0] ** 2))
                if low == high and k == h:
                    np.fill_diagonal(kernel, 0)
                inner, left, right = inner + ((kernel @ b[q]) * a[p]).sum(0), left + a[p].T @ kernel.sum(1), right + b[q].T @ kernel.sum(0)
                total += kernel.sum()
        # Every pair stands in both orders: in its one block pair, or twice where the blocks differ.
        both = (inner, left) if low == high else (2 * inner, left + right)
        whole = total * (1 if low == high else 2)
        return pd.DataFrame({"key": frame["key"].iloc[0], "r": np.arange(len(inner)), "inner": both[0], "one": both[1], "all": whole})

    parts = marked.groupBy("key", "low", "high").applyInPandas(sums, "key string, r long, inner double, one double, all double")
    totals = parts.groupBy("key", "r").agg(F.sum("inner").alias("a"), F.sum("one").alias("s"), F.sum("all").alias("t"))
    totals = totals.join(F.broadcast(sizes), "key").where("m >= 2 and n >= 2")
    m, n, a_, s_, t_ = (F.col(c) for c in ("m", "n", "a", "s", "t"))
    value = a_ / (m * (m - 1)) + (t_ - 2 * s_ + a_) / (n * (n - 1)) - 2 * (s_ - a_) / (m * n)
    values = totals.select("key", "r", value.alias("v"))
    seen = values.where("r = 0").select("key", F.col("v").alias("seen"))
    p = values.where("r > 0").join(F.broadcast(seen), "key").groupBy("key").agg(F.first("seen").alias("mmd2"), ((F.count_if(F.col("v") >= F.col("seen")) + 1) / (permutations + 1)).alias("p_value"))
    out = sizes.select("key").join(p, "key", "left").select("key", F.coalesce("mmd2", F.lit(0.0)).alias("mmd2"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"))
    return out.withColumn("drift", (F.sqrt(F.greatest("mmd2", F.lit(0.0))) > 0.1) | (F.col("p_value") < 0.05))


def subsample(groups: DataFrame, most: int = 200) -> DataFrame:
    """At most ``most`` rows of each key and side, by a hash of their id."""
    order = Window.partitionBy("key", "side").orderBy(F.xxhash64("id"), "id")
    return groups.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def multi_dimensional(scores: DataFrame) -> DataFrame:
    """Weighted status of each model from (model_id, drift_type, score, drift): equal weights of those present."""
    s = F.sum(0.25 * F.col("score")) / F.sum(F.when(F.col("score").isNotNull(), 0.25))
    out = scores.groupBy("model_id").agg(s.alias("s"), F.bool_or("drift").alias("any_drift"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("drift"), F.col("drift_type")))), ",").alias("causes"))
    level = F.when(F.col("s") < 0.1, "none").when(F.col("s") < 0.25, "low").when(F.col("s") < 0.5, "medium").when(F.col("s") < 0.75, "high").otherwise("critical")
    return out.select("model_id", F.round("s", 8).alias("score"), "any_drift", "causes", level.alias("severity"))


def correlations(daily: DataFrame, least: int = 3, strength: float = 0.5) -> DataFrame:
    """Pearson correlation of drift types over days, from (day, drift_type, score)."""
    a, b = daily.toDF("day", "left_type", "x"), daily.toDF("day", "right_type", "y")
    pairs = a.join(b, "day").where("left_type < right_type").groupBy("left_type", "right_type").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    return pairs.where((F.col("n") >= least) & (F.abs(F.coalesce("r", F.lit(0.0))) >= strength)).select("left_type", "right_type", F.round("r", 6).alias("r"), "n")



def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The reference window: the ``most`` newest rows of each key."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= most).drop("_k")


def argmax_class(probabilities: Column) -> Column:
    """Place, from 0, of the first largest probability."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def embedding_error(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2: how far an output lies from its input, for detectors over error streams."""
    return (1 - cosine(a, b)) / 2


def correct(attributes: Column) -> Column:
    """``correct`` says so if it is there, else ``error`` is 0, else the row counts as correct."""
    said = F.lower(F.try_element_at(attributes, F.lit("correct")))
    error = F.try_element_at(attributes, F.lit("error")).try_cast("double")
    return F.coalesce(said.isin("true", "1"), error == 0, F.lit(True))


def compare_histograms(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Largest and mean difference of bin shares between the sides, and bins that differ by over 5 %."""
    edge = rows.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counts = rows.join(F.broadcast(edge), "feature").groupBy("feature", place.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    whole = Window.partitionBy("feature")
    diff = F.abs(F.col("r") / F.sum("r").over(whole) - F.col("c") / F.sum("c").over(whole))
    shares = counts.select("feature", diff.alias("d"))
    return shares.groupBy("feature").agg(F.round(F.max("d"), 8).alias("max_diff"), F.round(F.avg("d"), 8).alias("mean_diff"), F.count_if(F.col("d") > 0.05).alias("bins_apart"))
