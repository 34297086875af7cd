"""A table of vectors with payloads that takes upserts and deletes, and is searched as it stands.

A store is a folder: ``base/version=n`` holds all points as of change n, ``delta/change=n`` what came after.  The last
change of a point wins; a delete is a point without a vector.  :func:`compact` writes a new base and drops what it
replaces.  Changes are written whole before they count, so that a failed one leaves the store as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import vectors
from spanloom.sources.monthly import _folders

POINT = "vec_id long, embedding array<double>, payload map<string,string>"


class StoreError(ValueError):
    """A change or a search that does not fit the store."""


def create(spark: SparkSession, folder: str, size: int, metric: str = "cosine") -> None:
    """An empty store for vectors of ``size`` entries; there must be none in the folder."""
    if describe(spark, folder):
        raise StoreError(f"{folder} holds a store")
    if metric not in ("cosine", "dot", "euclid", "manhattan"):
        raise StoreError(f"no metric: {metric}")
    spark.createDataFrame([(json.dumps({"size": size, "metric": metric}),)], "value string").coalesce(1).write.text(f"{folder}/about")


def describe(spark: SparkSession, folder: str) -> dict | None:
    """Size and metric of the store; None where there is none."""
    if not any(True for _ in _folders(spark, f"{folder}/about/_SUCCESS")):
        return None
    return json.loads(spark.read.text(f"{folder}/about").first().value)


def drop(spark: SparkSession, folder: str) -> bool:
    """Delete the store; whether there was one."""
    found = list(_folders(spark, folder)) if describe(spark, folder) else []
    return any([fs.delete(path, True) for fs, path in found])


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    return sorted(int(path.getParent().getName().split("=")[1]) for _, path in _folders(spark, f"{folder}/{kind}=*/_SUCCESS"))


def _change(points: DataFrame, folder: str) -> int:
    spark = points.sparkSession
    number = max([0, *_numbers(spark, folder, "base/version"), *_numbers(spark, folder, "delta/change")]) + 1
    points.write.mode("overwrite").parquet(f"{folder}/delta/change={number}")
    return number


def upsert(folder: str, points: DataFrame) -> int:
    """Add (vec_id, embedding, payload), in place of points of the same id; the number of the change.

    Points without an id are left out; of an id that is twice among them the larger vector counts.  A vector of
    another length, or one that is null or holds nulls, is an error, and then nothing is changed.
    """
    spark = points.sparkSession
    about = describe(spark, folder)
    if not about:
        raise StoreError(f"no store in {folder}")
    rows = points.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "payload")
    fits = F.col("embedding").isNotNull() & (F.size("embedding") == about["size"]) & F.forall("embedding", lambda x: x.isNotNull())
    if not rows.where(~fits).isEmpty():
        raise StoreError(f"vectors must have {about['size']} entries")
    newest = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("embedding"), F.array_sort(F.map_entries("payload"))))
    return _change(rows.withColumn("_n", newest).where("_n = 1").drop("_n"), folder)


def delete(folder: str, ids: DataFrame) -> int:
    """Take points away by ``vec_id``; ids that are not there change nothing."""
    none = lambda kind: F.lit(None).cast(kind)
    gone = ids.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    return _change(gone.select("vec_id", none("array<double>").alias("embedding"), none("map<string,string>").alias("payload")), folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, embedding, payload) as of the last change.

    Only changes are sorted by point; the base loses those ids that were changed, and is not shuffled where
    these are few.
    """
    base = _numbers(spark, folder, "base/version")
    since = base[-1] if base else 0
    changes = [n for n in _numbers(spark, folder, "delta/change") if n > since]
    rows = spark.read.schema(POINT).parquet(f"{folder}/base/version={since}") if base else spark.createDataFrame([], POINT)
    if not changes:
        return rows
    delta = spark.read.schema(f"{POINT}, change int").option("basePath", f"{folder}/delta").parquet(*(f"{folder}/delta/change={n}" for n in changes))
    last = delta.groupBy("vec_id").agg(F.max_by(F.struct("embedding", "payload"), "change").alias("p"))
    put = last.where("p.embedding is not null").select("vec_id", "p.embedding", "p.payload")
    return rows.join(delta.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(put)


def compact(spark: SparkSession, folder: str) -> int:
    """Write all points as a new base and drop older bases and the changes that it holds; its number."""
    bases, changes = _numbers(spark, folder, "base/version"), _numbers(spark, folder, "delta/change")
    number = max([0, *bases, *changes])
    if number and number not in bases:
        current(spark, folder).write.mode("overwrite").parquet(f"{folder}/base/version={number}")
    for pattern in (f"{folder}/base/version=*", f"{folder}/delta/change=*"):
        for fs, path in _folders(spark, pattern):
            old = int(path.getName().split("=")[1])
            if old < number or (old == number and "/delta/" in path.toString()):
                fs.delete(path, True)
    return number


def matches(payload: Column, conditions: list[tuple[str, str, str]]) -> Column:
    """Whether a payload meets all (field, eq or in, value); values of ``in`` are parted by commas.

    A field that a payload lacks meets no condition.
    """
    out = F.lit(True)
    for field, op, value in conditions:
        if op not in ("eq", "in"):
            raise StoreError(f"no comparison: {op}")
        found = F.try_element_at(payload, F.lit(field))
        out = out & F.coalesce(found.isin([value] if op == "eq" else value.split(",")), F.lit(False))
    return out


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, conditions: list[tuple[str, str, str]] = ()) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best points for each of (vec_id, embedding), of those that meet the conditions.

    Payloads are filtered before anything is compared.  A point is no answer to the query of its own id.
    """
    about = describe(spark, folder)
    if not about:
        raise StoreError(f"no store in {folder}")
    rows = current(spark, folder).where(matches(F.col("payload"), list(conditions)))
    return vectors.top_k(rows, queries, k, about["metric"])
