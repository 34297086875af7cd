"""Trace and metric tables in one folder a month, written in batches and expired by month.

A table is ``month=yyyyMM/batch=name`` folders of Parquet.  A batch that is written again, after a failure or
on purpose, replaces itself in every month and nothing else, so that writing is idempotent.  Readers name a
range of time; Spark lists the folders of its months only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the tables; what a batch lacks is null there, what it has beside them is left out.
TRACES = "trace_id string, span_id string, service_name string, model_id string, user_id string, status string, latency_ms double, input_tokens long, output_tokens long, cost_micros long, timestamp timestamp_ntz"
METRICS = "name string, labels map<string,string>, x double, timestamp timestamp_ntz"


def month(time: Column) -> Column:
    """yyyyMM as a number; rows without a time are of month 0."""
    return F.coalesce(F.year(time) * 100 + F.month(time), F.lit(0)).cast("int")


def _folders(spark: SparkSession, pattern: str) -> Iterator:
    """(file system, path) of what matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        yield fs, status.getPath()


def _month_of(path) -> int:
    return int(re.search(r"month=(\d+)", path.toString())[1])


def insert(rows: DataFrame, folder: str, batch: str, columns: str = TRACES, time: str = "timestamp") -> None:
    """Write a batch; one of this name that was written before is replaced, in all of its months.

    Rows of a month are dealt over as many tasks as their size asks for.
    """
    spark = rows.sparkSession
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not the name of a batch: {batch!r}")
    fields = T.StructType.fromDDL(columns).fields
    out = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    out = out.withColumns({"month": month(F.col(time)), "batch": F.lit(batch)})
    held = {_month_of(path): (fs, path) for fs, path in _folders(spark, f"{folder}/month=*/batch={batch}")}
    if held:  # months that the batch no longer has
        now = {r.month for r in out.select("month").distinct().collect()}
        for old in held.keys() - now:
            held[old][0].delete(held[old][1], True)
    writer = out.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month", "batch").parquet(folder)


def read(spark: SparkSession, folder: str, columns: str = TRACES, since: str | None = None, until: str | None = None, time: str = "timestamp") -> DataFrame:
    """Rows from ``since`` on and before ``until``, both days or times as text, from their months' folders."""
    schema = T.StructType.fromDDL(columns)
    if not any(True for _ in _folders(spark, f"{folder}/month=*")):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.add("month", T.IntegerType()).add("batch", T.StringType())).parquet(folder)
    for text, after in ((since, True), (until, False)):
        if text is not None:
            at = F.lit(text).cast("timestamp_ntz")
            rows = rows.where((F.col(time) >= at) & (F.col("month") >= month(at)) if after else (F.col(time) < at) & (F.col("month") <= month(at)))
    return rows.drop("month", "batch")


def expire(spark: SparkSession, folder: str, before: int) -> list[int]:
    """Drop the folders of months before ``before`` (yyyyMM), without reading them; which they were.

    Rows without a time stay.
    """
    gone = [(fs, path) for fs, path in _folders(spark, f"{folder}/month=*") if 0 < _month_of(path) < before]
    for fs, path in gone:
        fs.delete(path, True)
    return sorted(_month_of(path) for _, path in gone)


def expire_days(spark: SparkSession, folder: str, days: int, time: str = "timestamp", columns: str = TRACES) -> list[int]:
    """As :func:`expire`: months of which every row is older than ``days`` before the table's newest row."""
    months = [_month_of(path) for _, path in _folders(spark, f"{folder}/month=*")]
    if not any(months):
        return []
    newest = read(spark, folder, columns).agg(month(F.max(time) - F.make_dt_interval(F.lit(days))).alias("m")).first().m
    return expire(spark, folder, newest)
