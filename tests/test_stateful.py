import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import detectors, sequential
from spanloom.session import Workspace
from spanloom.streaming import jobs, stateful

START = datetime(2024, 1, 1)


def outcomes(spark, n=600, keys=3, seed=5):
    mark = random.Random(seed)
    rows = [(f"k{i % keys}", START + timedelta(seconds=i), i, float(mark.random() < (0.05 if i < n / 2 else 0.5))) for i in range(n)]
    return spark.createDataFrame(rows, "key string, timestamp timestamp, seq long, x double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def found(frame):
    return sorted((r.key, r.seq, r.n, r.state, round(r.value, 8)) for r in frame.collect())


@pytest.mark.parametrize("kind", sorted(detectors.DETECTORS))
def test_a_run_in_parts_finds_what_one_run_finds(spark, kind):
    rows, settings = outcomes(spark), {"threshold": 3.0} if kind == "page_hinkley" else {}
    work = Workspace(spark, "detectors")
    whole, states = detectors.advance(work, rows, kind, **settings)
    want = found(whole)
    assert want and states.count() == 3
    parts, states = [], None
    for low, high in ((0, 1), (1, 250), (250, 251), (251, 600), (600, 700)):
        some, states = detectors.advance(work, rows.where(F.col("seq").between(low, high - 1)), kind, states, **settings)
        parts += found(some)
    assert sorted(parts) == want and states.count() == 3


def test_detectors_equal_the_windowed_operators(spark):
    rows, work = outcomes(spark), Workspace(spark, "detectors")
    errors = rows.select("key", "timestamp", "seq", F.col("x").cast("int").alias("error"))
    same = lambda kind: {(r.key, r.seq, r.state) for r in detectors.advance(work, rows, kind)[0].collect()}
    for kind, frame in (("ddm", sequential.ddm(errors)), ("eddm", sequential.eddm(errors))):
        assert same(kind) == {(r.key, r.seq, r.state) for r in frame.where("state <> 'stable'").collect()}
    cuts = {(r.key, r.seq, r.width) for r in sequential.adwin(rows).collect()}
    assert {(r.key, r.seq, r.n) for r in detectors.advance(work, rows, "adwin")[0].collect()} == cuts


def test_page_hinkley_starts_anew_after_an_alarm(spark):
    rows = outcomes(spark, 900, 2)
    got = found(detectors.advance(Workspace(spark, "ph"), rows, "page_hinkley", threshold=2.0, least=5)[0])
    want = []
    for key in ("k0", "k1"):
        n = total = low = up = 0.0
        for r in sorted((r for r in rows.collect() if r.key == key), key=lambda r: r.seq):
            up += r.x - (total / n if n else 0) - 0.005
            n, total, low = n + 1, total + r.x, min(low, up)
            if n >= 5 and up - low > 2.0:
                want.append((key, r.seq, int(n), "drift", round(up - low, 8)))
                n = total = low = up = 0.0
    assert len(want) > 4 and got == sorted(want)


def test_a_stream_goes_on_from_a_table_and_after_a_restart(spark, tmp_path):
    rows = outcomes(spark, 300, 2)
    want, _ = detectors.advance(Workspace(spark, "one"), rows, "ddm")
    first, states = detectors.advance(Workspace(spark, "two"), rows.where("seq < 90"), "ddm")
    got = found(first)
    for k, (low, high) in enumerate(((90, 160), (160, 300))):
        rows.where(F.col("seq").between(low, high - 1)).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{tmp_path}/in/part={k}")
        source = spark.readStream.schema("key string, timestamp timestamp, seq long, x double, part int").parquet(f"{tmp_path}/in")
        table = jobs.to_table(stateful.detect(source, "ddm", states), "append", f"{tmp_path}/out")
    assert got + [] and sorted(got + found(table)) == found(want)


def write(spark, tmp_path, k, rows):
    spark.createDataFrame(rows, "trace_id string, timestamp timestamp, model_id string").write.parquet(f"{tmp_path}/in/part={k}")


def test_batches_close_by_size_or_time(spark, tmp_path):
    def rows(model, n, start, step=1):
        return [(f"{model}{start + i}", START + timedelta(seconds=start + i * step), model) for i in range(n)]

    steps = [rows("a", 25, 0) + rows("b", 4, 0), rows("a", 4, 100) + rows("late", 3, 0), rows("a", 5, 300) + rows("b", 2, 200), rows("c", 1, 5000)]
    for k, step in enumerate(steps):
        write(spark, tmp_path, k, step)
        source = spark.readStream.schema("trace_id string, timestamp timestamp, model_id string, part int").parquet(f"{tmp_path}/in")
        table = jobs.to_table(stateful.batches(source, 8, 10, 60.0), "append", f"{tmp_path}/out")
    got = {}
    for r in table.collect():
        got.setdefault((r.model_id, r.batch, r.closed_by), set()).add(r.trace_id)
    every = sorted(t for v in got.values() for t in v)
    assert every == sorted(r[0] for step in steps[:3] for r in step)  # each once; the newest is still open
    assert all(len(v) <= 10 for v in got.values())
    sizes = sorted((k[0], k[2], len(v)) for k, v in got.items())
    assert sizes == [("a", "enough", 9), ("a", "size", 10), ("a", "size", 10), ("a", "time", 5), ("b", "time", 6), ("late", "time", 3)]


def test_episodes_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    mark = random.Random(6)
    events, now = [], 0
    for _ in range(250):
        now += mark.choice([1, 2, 5, 14, 15, 16, 40])
        events.append((mark.choice("xyz"), START + timedelta(minutes=now)))
    silences = [(START + timedelta(minutes=100), START + timedelta(minutes=300), "x"), (START + timedelta(minutes=290), START + timedelta(minutes=320), None), (START + timedelta(minutes=900), START + timedelta(minutes=905), "z")]
    calm = spark.createDataFrame(silences, "start timestamp, stop timestamp, fingerprint string")
    # shuffled within eight minutes
    order = sorted(range(len(events)), key=lambda i: events[i][1] + timedelta(minutes=mark.uniform(0, 8)))
    for k in range(5):
        rows = [events[i] for i in order[k * 50 : (k + 1) * 50]]
        spark.createDataFrame(rows, "fingerprint string, timestamp timestamp").write.parquet(f"{tmp_path}/in/part={k}")
        source = spark.readStream.schema("fingerprint string, timestamp timestamp, part int").parquet(f"{tmp_path}/in")
        table = jobs.to_table(jobs.alert_episodes(source, 15, 24, calm), "append", f"{tmp_path}/out")
    want = []
    for f in "xyz":
        own = sorted(t for g, t in events if g == f)
        cuts = [0, *(i for i in range(1, len(own)) if own[i] - own[i - 1] >= timedelta(minutes=15)), len(own)]
        for i, j in zip(cuts, cuts[1:]):
            end, at = own[j - 1] + timedelta(minutes=15), own[i]
            for start, stop, only in silences:
                at = stop if start <= at < stop and only in (None, f) else at
            want.append((f, own[i], own[j - 1], end, j - i, own[j - 1] + timedelta(hours=24), at if at < end else None))
    got = [(r.fingerprint, r.opened_at, r.last_at, r.resolved_at, r.n, r.expires_at, r.notify_at) for r in table.collect()]
    closed = [w for w in want if w[3] <= max(t for _, t in events) - timedelta(minutes=10)]
    assert sorted(got, key=str) == sorted(closed, key=str) and any(w[6] is None for w in closed) and any(w[6] and w[6] != w[1] for w in closed)
