"""References of drift tests that are stored, grow batch by batch and are read by later sessions.

A store is a folder of versions.  A version is written whole before it counts: readers take the newest one that
Spark's writer marked as done, so that a failed update leaves the last one in use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import drift
from spanloom.sources.monthly import _folders

#: A model's reference may grow to so many vectors; then the newest ``KEPT`` stay.
MOST, KEPT = 10_000, 5_000
_KINDS = ("embeddings", "centroids", "psi")


def _versions(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the versions that are complete."""
    return sorted(int(path.getParent().getName().removeprefix("version=")) for _, path in _folders(spark, f"{folder}/{kind}/version=*/_SUCCESS"))


def load(spark: SparkSession, folder: str, kind: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version of a store's table, or an older one; None where there is none."""
    if kind not in _KINDS:
        raise ValueError(kind)
    found = _versions(spark, folder, kind)
    if not found or (version is not None and version not in found):
        return None
    return spark.read.parquet(f"{folder}/{kind}/version={found[-1] if version is None else version}")


def _save(rows: DataFrame, folder: str, kind: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{kind}/version={version}")


def _parts(rows: DataFrame, sign: int) -> DataFrame:
    """(model_id, i, x): components, to be added or taken away."""
    return rows.select("model_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double") * sign)


def upsert(folder: str, batch: DataFrame, most: int = MOST, kept: int = KEPT) -> int:
    """Add (model_id, vec_id, at, embedding) to the stored reference; the number of the new version.

    A vector with an id that is there replaces the old one.  A model that would have more than ``most`` keeps the
    ``kept`` newest, by ``at`` and id.  Its centroid is kept as sums: what came is added and what went is taken away, so
    that no stored vector is summed again.  Rows without model, id or vector are left out; of an id that is twice in
    a batch the newest counts.
    """
    spark = batch.sparkSession
    rows = batch.where("model_id is not null and vec_id is not null and size(embedding) > 0").select("model_id", "vec_id", "at", F.col("embedding").cast("array<double>").alias("embedding"))
    newest = Window.partitionBy("model_id", "vec_id").orderBy(F.desc("at"), F.desc("embedding"))
    rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    number = max([0, *_versions(spark, folder, "centroids")]) + 1
    old = load(spark, folder, "embeddings", number - 1)
    old = rows.limit(0) if old is None else old
    marked = old.withColumn("old", F.lit(True)).unionByName(rows.withColumn("old", F.lit(False)))
    # The new one of an id stands before the old one.
    by_id = Window.partitionBy("model_id", "vec_id").orderBy("old")
    marked = marked.withColumn("stays", F.row_number().over(by_id) == 1)
    sizes = marked.groupBy("model_id").agg(F.count_if("stays").alias("n"))
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("at"), F.desc("vec_id")))
    newest = marked.where("stays").withColumn("rank", rank).where(F.col("rank") <= kept).select("model_id", "vec_id", F.lit(True).alias("new"))
    marked = marked.join(sizes, "model_id").join(newest, ["model_id", "vec_id"], "left")
    marked = marked.withColumn("stays", F.col("stays") & ((F.col("n") <= most) | F.col("new").isNotNull()))
    path = f"{folder}/changes/version={number}"
    marked.drop("n", "new").write.mode("overwrite").parquet(path)
    marked = spark.read.parquet(path)
    _save(marked.where("stays").drop("stays", "old"), folder, "embeddings", number)
    moved = _parts(marked.where("stays and not old"), 1).union(_parts(marked.where("not stays and old"), -1))
    counts = marked.groupBy("model_id").agg((F.count_if(F.col("stays") & ~F.col("old")) - F.count_if(~F.col("stays") & F.col("old"))).alias("n"))
    before = load(spark, folder, "centroids")
    if before is not None:
        moved = moved.union(before.select("model_id", F.posexplode("sums").alias("i", "x")))
        counts = counts.union(before.select("model_id", "n")).groupBy("model_id").agg(F.sum("n").alias("n"))
    sums = moved.groupBy("model_id", "i").agg(F.sum("x").alias("x")).groupBy("model_id")
    sums = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums"))
    _save(sums.join(counts, "model_id"), folder, "centroids", number)
    return number


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """(model_id, n, centroid) of the stored reference."""
    return load(spark, folder, "centroids").where("n > 0").select("model_id", "n", F.transform("sums", lambda x: x / F.col("n")).alias("centroid"))


def centroid_drift(folder: str, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(model_id, n_reference, n_current, score, drift) of (model_id, embedding) against the stored centroids.

    The score is 1 - cosine of the two centroids.  Models that only one side has are left out.
    """
    own = drift.centroids(current, ["model_id"]).withColumnRenamed("centroid", "now")
    sizes = current.groupBy("model_id").agg(F.count("embedding").alias("n_current"))
    both = centroids(current.sparkSession, folder).join(own, "model_id").join(sizes, "model_id")
    score = 1 - drift.cosine(F.col("centroid"), F.col("now"))
    return both.select("model_id", F.col("n").alias("n_reference"), "n_current", F.round(score, 6).alias("score"), (score > threshold).alias("drift"))


def store_psi(folder: str, values: DataFrame, bins: int = drift.PSI_BINS) -> int:
    """Store the bins of (feature, v) as a new version, for features that are in it; others keep theirs."""
    spark = values.sparkSession
    number = max([0, *_versions(spark, folder, "psi")]) + 1
    rows, old = drift.psi_reference(values, bins), load(spark, folder, "psi")
    if old is not None:
        rows = rows.unionByName(old.join(values.select("feature").distinct(), "feature", "left_anti"))
    _save(rows, folder, "psi", number)
    return number


def psi_drift(folder: str, values: DataFrame) -> DataFrame:
    """Population stability index of (feature, v) against the bins that were stored."""
    return drift.psi_against(load(values.sparkSession, folder, "psi"), values)
