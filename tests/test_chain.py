import random
import time

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanloom.streaming import jobs, statistics
from spanloom.streaming.chain import Processor, run_chain


def double(frame: pd.DataFrame) -> pd.DataFrame:
    if (frame["n"] % 7 == 3).any():
        raise KeyError("three")
    frame["n"] *= 2
    return frame


def chain(rate=1.0):
    return [
        Processor("upper", {"t": F.upper("t")}, F.when(F.col("t").contains("bad"), "bad text")),
        Processor("double", run=double, rate=rate),
        Processor("length", {"n": F.col("n") + F.length("t")}, F.when(F.col("n") > 150, F.concat(F.lit("too large: "), F.col("n")))),
    ]


def plain(rows, stop, due=lambda i: True):
    out = {}
    for i, t, n in rows:
        failed = []
        if "bad" in t:
            failed.append(("upper", "bad text"))
        else:
            t = t.upper()
        if due(i) and not (stop and failed):
            if n % 7 == 3:
                failed.append(("double", "KeyError: 'three'"))
            else:
                n *= 2
        if not (stop and failed):
            if n > 150:
                failed.append(("length", f"too large: {n}"))
            else:
                n += len(t)
        out[i] = (t, n, failed)
    return out


def test_rows_keep_their_earlier_form_where_a_processor_fails(spark):
    rows = [(i, ("bad" if i % 11 == 0 else "x") * (i % 4), i) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, t string, n long").repartition(3)
    for stop in (False, True):
        seen = Observation()
        got = {r.id: (r.t, r.n, [tuple(f) for f in r.failures]) for r in run_chain(frame, chain(), "id", stop, seen).collect()}
        want = plain(rows, stop)
        assert got == want
        names = [name for _, _, failed in want.values() for name, _ in failed]
        assert seen.get == {"rows": 120, "failed_upper": names.count("upper"), "failed_double": names.count("double"), "failed_length": names.count("length")}


def test_some_rows_are_sampled_the_same_in_every_run(spark):
    rows = [(i, "x", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, t string, n long")
    half = lambda parts: {r.id: r.n for r in run_chain(frame.repartition(parts), [Processor("plus", {"n": F.col("n") + 1}, rate=0.3)], "id").collect()}
    got = half(2)
    assert got == half(5) and 230 < sum(n != i for i, n in got.items()) < 370


def test_listener_counts_batches_and_failures(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10 * (k + 1)).select("id", F.lit("bad").alias("t"), F.col("id").alias("n")).write.parquet(f"{tmp_path}/in/part={k}")
    stats = statistics.Statistics()
    spark.streams.addListener(stats)
    try:
        source = spark.readStream.schema("id long, t string, n long, part int").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in").drop("part")
        out = run_chain(source, chain()[:1], "id", observed="chain")
        query = out.writeStream.queryName("checked").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if stats.of("checked")["rows"] == 60:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(stats)
    got = stats.of("checked")
    assert got["rows"] == 60 and got["failed"] == 60 and got["batches"] >= 1 and got["avg_ms"] > 0


def test_moving_averages_of_a_scripted_stream():
    stats, size, slow, top = statistics.Statistics(), 0.0, 0.0, 0.0
    for rows, millis in ((100, 50), (0, 1000), (10, 400), (55, 20)):
        stats.add("q", rows, millis, rows // 10)
        if rows:
            size, slow = 0.1 * rows + 0.9 * size, 0.1 * millis + 0.9 * slow
            top = 0.99 * millis + 0.01 * top if millis > top else 0.01 * millis + 0.99 * top
    got = stats.of("q")
    assert (got["batches"], got["rows"], got["failed"]) == (3, 165, 16)
    assert abs(got["avg_batch_size"] - size) < 1e-9 and abs(got["avg_ms"] - slow) < 1e-9 and abs(got["slow_ms"] - top) < 1e-9


def test_sketches_merge_and_stay_within_their_error(spark):
    mark = random.Random(2)
    rows = [(mark.choice("ab"), mark.choice([mark.lognormvariate(2, 3), 0.0, -1.0, 5.0, mark.random() * 1e-6])) for _ in range(3000)] + [("c", None), ("c", 7.0)]
    frame = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    parts = [statistics.sketch(f, ["k"], "x") for f in (frame.where("x < 1"), frame.where("x >= 1"))]
    whole = {r.k: r for r in statistics.quantiles(statistics.sketch(frame, ["k"], "x"), ["k"], shares).collect()}
    merged = {r.k: r for r in statistics.quantiles(statistics.merge(*parts), ["k"], shares).collect()}
    assert merged == whole and sorted(whole) == ["a", "b", "c"]
    for k, r in whole.items():
        own = sorted(max(x, 0.0) for g, x in rows if g == k and x is not None)
        assert r.n == len(own)
        for s in shares:
            want, got = own[int(s * (len(own) - 1))], r[f"p{s * 100:g}"]
            assert abs(got - want) <= statistics.ERROR * want * 1.0001


def test_functions_get_rows_of_one_file_in_many_tasks(spark):
    rows = spark.range(4000).coalesce(1)
    slow = Processor("tasks", run=lambda frame: frame)
    plan = run_chain(rows, [slow], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInPandas")[1]
    some = Processor("odd", run=lambda frame: frame if (frame["id"] % 7 != 3).all() else 1 / 0, rate=0.5)
    got = run_chain(rows, [some], "id").collect()
    assert sorted(r.id for r in got) == list(range(4000))
    failed = {r.id for r in got if r.failures}
    assert failed and all(i % 7 == 3 for i in failed) and len(failed) < 4000 / 7
