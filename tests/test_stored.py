import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import drift, references
from spanloom.sources import monthly


def traces(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, timestamp string, latency_ms double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def months(folder):
    return sorted(p.name for p in folder.iterdir() if p.name.startswith("month="))


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    folder = tmp_path / "t"
    first = traces(spark, [("a", "2024-01-05 00:00:00", 1.0), ("b", "2024-02-01 00:00:00", 2.0), ("c", None, 3.0)])
    second = traces(spark, [("d", "2024-02-09 00:00:00", 4.0)])
    for batch, name in ((first, "one"), (second, "two"), (first, "one")):
        monthly.insert(batch, str(folder), name)
    ids = lambda **k: sorted(r.trace_id for r in monthly.read(spark, str(folder), **k).collect())
    assert ids() == ["a", "b", "c", "d"] and months(folder) == ["month=0", "month=202401", "month=202402"]
    monthly.insert(first.where("trace_id = 'a'"), str(folder), "one")  # the batch's later form has no February
    assert ids() == ["a", "d"]
    assert ids(since="2024-02-01") == ["d"] and ids(until="2024-02-09") == ["a"]
    got = monthly.read(spark, str(folder)).first()
    assert got.model_id is None and "month" not in got.asDict()
    with pytest.raises(ValueError):
        monthly.insert(first, str(folder), "../x")


def test_a_range_lists_its_months_only_and_old_months_go(spark, tmp_path):
    folder = tmp_path / "t"
    rows = [(f"{y}{m}", f"{y}-{m:02}-15 00:00:00", 1.0) for y in (2023, 2024) for m in range(1, 13)]
    monthly.insert(traces(spark, rows), str(folder), "all")
    plan = monthly.read(spark, str(folder), since="2024-03-02", until="2024-03-20")._jdf.queryExecution().executedPlan()
    scan = next(p for p in iterate(plan) if p.getClass().getSimpleName() == "FileSourceScanExec")
    assert "month" in scan.partitionFilters().toString()
    assert monthly.read(spark, str(folder), since="2024-03-02", until="2024-03-20").inputFiles()
    metrics = scan.selectedPartitions()
    assert metrics.partitionCount() == 1
    assert monthly.expire_days(spark, str(folder), 70) == [202301 + i for i in range(12)] + [202401 + i for i in range(9)]
    assert months(folder) == ["month=202410", "month=202411", "month=202412"]
    assert monthly.expire(spark, str(folder), 0) == [] and monthly.read(spark, str(tmp_path / "none")).count() == 0


def iterate(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from iterate(children.apply(i))
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from iterate(plan.inputPlan())


def test_centroids_follow_upserts(spark, tmp_path):
    mark, folder, want = random.Random(2), str(tmp_path / "r"), {}
    for step in range(6):
        batch = {}
        for _ in range(mark.randrange(5, 25)):
            batch[mark.choice("ab"), mark.randrange(40)] = (step * 100 + mark.randrange(100), [mark.uniform(-1, 1) for _ in range(3)])
        rows = [(m, i, at, v) for (m, i), (at, v) in batch.items()] + [(None, 1, 1, [1.0, 1.0, 1.0]), ("a", None, 1, [1.0, 1.0, 1.0]), ("a", 99, 1, None)]
        assert references.upsert(folder, spark.createDataFrame(rows, "model_id string, vec_id long, at long, embedding array<double>"), 20, 12) == step + 1
        want |= batch
        for model in "ab":
            own = sorted((k for k in want if k[0] == model), key=lambda k: (want[k][0], k[1]), reverse=True)
            if len(own) > 20:
                for k in own[12:]:
                    del want[k]
        got = {(r.model_id, r.vec_id): (r["at"], r.embedding) for r in references.load(spark, folder, "embeddings").collect()}
        assert got == want
        for r in references.centroids(spark, folder).collect():
            own = [v for (m, _), (_, v) in want.items() if m == r.model_id]
            assert r.n == len(own) and r.centroid == pytest.approx([sum(x) / len(own) for x in zip(*own)], abs=1e-9)
    assert references.load(spark, folder, "embeddings", 1).count() <= 25 and references.load(spark, folder, "psi") is None


def test_a_broken_version_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "r")
    frame = lambda rows: spark.createDataFrame(rows, "model_id string, vec_id long, at long, embedding array<double>")
    references.upsert(folder, frame([("a", 1, 1, [1.0, 0.0])]))
    # a session that ended between its two tables
    references._save(frame([("a", 1, 1, [1.0, 0.0]), ("a", 2, 2, [9.0, 9.0])]), folder, "embeddings", 2)
    assert references.upsert(folder, frame([("a", 2, 2, [0.0, 1.0])])) == 2
    assert [tuple(r) for r in references.centroids(spark, folder).collect()] == [("a", 2, [0.5, 0.5])]
    now = frame([("a", 1, 1, [1.0, 1.0]), ("b", 1, 1, [1.0, 1.0])]).select("model_id", "embedding")
    assert [tuple(r) for r in references.centroid_drift(folder, now).collect()] == [("a", 2, 1, 0.0, False)]


def test_running_totals_over_slices(spark):
    mark = random.Random(8)
    rows = [("f", mark.choice([mark.gauss(0, 1), mark.gauss(0, 1e6), 0.0, 5.0])) for _ in range(400)] + [("one", 3.0)] * 5 + [("g", float("inf")), ("g", 1.0), ("g", float("-inf")), ("g", float("nan"))]
    counts = spark.createDataFrame(rows, "feature string, v double").groupBy("feature", "v").agg(F.count("*").alias("k"))
    got = {}
    for r in drift.running(counts, ["k"]).collect():
        got.setdefault(r.feature, []).append((r.v != r.v, r.v, r.k, r.upto_k))
    for own in got.values():
        total = 0
        for _, _, k, upto in sorted(own, key=lambda x: (x[0], 0 if x[0] else x[1])):
            total += k
            assert upto == total
