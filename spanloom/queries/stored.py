"""Tables that are kept between sessions: months of traces and metrics, references, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import references
from spanloom.queries.drift import _LONG, _long
from spanloom.session import Workspace
from spanloom.sources import monthly
from spanloom.sources import views as V
from spanloom.sources.tables import table
from spanloom.streaming import statistics
from spanloom.streaming.chain import Processor, run_chain

_T = V.with_views(V.TRACES_SQL)


def _orders(s, d):
    """Order lines as traces, years of them."""
    return V.usage(s, d).withColumns({"service_name": F.col("feature_id"), "status": F.lit("ok")})


def _insert(s, d, folder):
    """Two batches, the first of which is written again."""
    rows = _orders(s, d)
    first = F.col("service_name") < "3"
    for _ in range(2):
        monthly.insert(rows.where(first), folder, "first")
    monthly.insert(rows.where(~first), folder, "second")
    return folder


def traces_monthly(s, d):
    folder = _insert(s, d, Workspace(s, "monthly").root)
    rows = monthly.read(s, folder)
    return rows.groupBy(F.date_format("timestamp", "yyyyMM").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"), F.sum("input_tokens").alias("tokens"))


def traces_month_range(s, d):
    folder = _insert(s, d, Workspace(s, "monthly").root)
    rows = monthly.read(s, folder, since="1996-03-15", until="1996-05-02")
    return rows.groupBy("service_name").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"))


def traces_expired(s, d):
    folder = _insert(s, d, Workspace(s, "monthly").root)
    monthly.expire_days(s, folder, 365)
    return monthly.read(s, folder).groupBy("model_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"))


def metrics_monthly(s, d):
    folder = Workspace(s, "metrics").root
    e = table(s, d, "events")
    rows = e.select(F.concat(F.lit("latency."), "event_type").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), F.col("value").alias("x"), F.col("ts").alias("timestamp"))
    for _ in range(2):
        monthly.insert(rows, folder, "all", monthly.METRICS)
    out = monthly.read(s, folder, monthly.METRICS, since="2024-01-10")
    return out.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"), F.count_distinct(F.col("labels")["user"]).alias("users"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("model_"), F.col("vec_id") % 2).alias("model_id"), "vec_id", F.col("vec_id").alias("at"), "embedding", "label")


#: Sizes of the stored references, small enough for all tables to reach them.
_MOST, _KEPT = 60, 40


def _stored(s, d):
    """Every vector by label, batch after batch, some of them twice with another value."""
    folder, rows = Workspace(s, "references").root, _vectors(s, d)
    for low, high in ((0, 3), (3, 6), (6, 10)):
        references.upsert(folder, rows.where(F.col("label").between(low, high - 1)).drop("label"), _MOST, _KEPT)
    again = rows.where("label = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)).drop("label")
    references.upsert(folder, again, _MOST, _KEPT)
    return folder


def reference_centroids(s, d):
    rows = references.centroids(s, _stored(s, d))
    return rows.select("model_id", "n", F.posexplode("centroid").alias("i", "x")).select("model_id", "n", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


def reference_centroid_drift(s, d):
    rows = _vectors(s, d).where("label < 5").select("model_id", "embedding")
    return references.centroid_drift(_stored(s, d), rows)


_STEPS = ((0, 3), (3, 6), (6, 10), (0, 1))


def _reference_sql() -> str:
    """The store's rows, step by step."""
    cut = f"""SELECT * EXCLUDE (r, c) FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY vec_id DESC) AS r, count(*) OVER (PARTITION BY m) AS c FROM ({{}})) WHERE c <= {_MOST} OR r <= {_KEPT}"""
    out = ["v AS (SELECT 'model_' || vec_id % 2 AS m, vec_id, label, embedding FROM embeddings)"]
    for k, (low, high) in enumerate(_STEPS):
        twice = k == len(_STEPS) - 1
        new = f"SELECT m, vec_id, {'list_transform(embedding, lambda x: x * 2)' if twice else 'embedding'} AS embedding FROM v WHERE label >= {low} AND label < {high}"
        old = f"UNION ALL SELECT * FROM s{k - 1} WHERE vec_id NOT IN (SELECT vec_id FROM v WHERE label >= {low} AND label < {high})" if k else ""
        out.append(f"s{k} AS ({cut.format(f'{new} {old}')})")
    out.append(f"x AS (SELECT m, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM s{len(_STEPS) - 1})")
    return "WITH " + ", ".join(out)


def psi_stored(s, d):
    """Bins are stored, some features anew, and read back for the later values."""
    folder, rows = Workspace(s, "bins").root, _long(s, d)
    old = rows.where("side = 'ref'").select("feature", "v")
    references.store_psi(folder, old)
    references.store_psi(folder, old.where("feature = 'l_tax'"))
    return references.psi_drift(folder, rows.where("side = 'cur'").select("feature", "v"))


def latency_sketches(s, d):
    """A sketch of each hour, merged to one of each service."""
    t = V.traces(s, d).withColumn("hour", F.date_trunc("hour", "timestamp"))
    hourly = statistics.sketch(t, ["service_name", "hour"], "latency_ms")
    out = statistics.quantiles(statistics.merge(hourly.drop("hour")), ["service_name"], [0.5, 0.95, 0.99])
    return out.select("service_name", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


def processor_chain(s, d):
    """Traces through three processors; what fails keeps its earlier form."""
    def shout(frame):
        if (frame["output_tokens"] > 190).any():
            raise ValueError("too many tokens")
        return frame.assign(service_name=frame["service_name"].str.upper())

    steps = [
        Processor("cost", {"cost_micros": F.col("cost_micros") * 2}, F.when(F.col("is_error"), "an error costs nothing")),
        Processor("shout", run=shout),
        Processor("user", {"user_id": F.lit("hidden")}, F.when(F.col("service_name") == "view", "views are kept")),
    ]
    rows = run_chain(V.traces(s, d), steps, "trace_id")
    return rows.select("trace_id", "service_name", "user_id", "cost_micros", F.array_join(F.transform("failures", lambda f: f["processor"]), ",").alias("failed"))


QUERIES = {
    "latency_sketches": latency_sketches,
    "processor_chain": processor_chain,
    "traces_monthly": traces_monthly,
    "traces_month_range": traces_month_range,
    "traces_expired": traces_expired,
    "metrics_monthly": metrics_monthly,
    "reference_centroids": reference_centroids,
    "reference_centroid_drift": reference_centroid_drift,
    "psi_stored_reference": psi_stored,
}

_U = V.with_views(V.USAGE_SQL)
ORACLE_SQL = {
    "latency_sketches": f"""{_T}, b AS (SELECT service_name, CASE WHEN latency_ms > 0 THEN ceil(ln(latency_ms) / ln(1.01 / 0.99)) ELSE -1e9 END AS b, count(*) AS c FROM traces GROUP BY ALL),
      u AS (SELECT *, sum(c) OVER (PARTITION BY service_name ORDER BY b) AS upto, sum(c) OVER (PARTITION BY service_name) AS n FROM b),
      q AS (SELECT service_name, n, p, min(b) AS b FROM u, (VALUES (0.5), (0.95), (0.99)) v(p) WHERE upto > floor(CAST(p AS DOUBLE) * (n - 1)) GROUP BY ALL),
      x AS (SELECT service_name, n, p, CASE WHEN b = -1e9 THEN 0 ELSE round(2 * pow(1.01::DOUBLE / 0.99, b) / (1.01::DOUBLE / 0.99 + 1), 6) END AS v FROM q)
      SELECT service_name, CAST(any_value(n) AS BIGINT) AS n, max(v) FILTER (p = 0.5) AS p50, max(v) FILTER (p = 0.95) AS p95, max(v) FILTER (p = 0.99) AS p99 FROM x GROUP BY 1""",
    "processor_chain": f"""{_T}, c AS (SELECT *, output_tokens > 190 AS many FROM traces),
      r AS (SELECT trace_id, CASE WHEN many THEN service_name ELSE upper(service_name) END AS service_name, user_id, CASE WHEN is_error THEN cost_micros ELSE cost_micros * 2 END AS cost_micros, is_error, many FROM c)
      SELECT trace_id, service_name, CASE WHEN service_name = 'view' THEN user_id ELSE 'hidden' END AS user_id, cost_micros,
        concat_ws(',', CASE WHEN is_error THEN 'cost' END, CASE WHEN many THEN 'shout' END, CASE WHEN service_name = 'view' THEN 'user' END) AS failed FROM r""",
    "traces_monthly": f"""{_U} SELECT strftime("timestamp", '%Y%m') AS month, count(*) AS n, count(DISTINCT trace_id) AS traces, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1""",
    "traces_month_range": f"""{_U} SELECT feature_id AS service_name, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS tokens FROM usage
      WHERE "timestamp" >= TIMESTAMP '1996-03-15' AND "timestamp" < TIMESTAMP '1996-05-02' GROUP BY 1""",
    "traces_expired": f"""{_U} SELECT model_id, count(*) AS n, min("timestamp") AS oldest FROM usage
      WHERE date_trunc('month', "timestamp") >= (SELECT date_trunc('month', max("timestamp") - INTERVAL 365 DAY) FROM usage) GROUP BY 1""",
    "metrics_monthly": """SELECT 'latency.' || event_type AS name, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events
      WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""",
    "reference_centroids": f"""{_reference_sql()} SELECT m AS model_id, count(*) AS n, i, round(avg(x), 5) AS x FROM x GROUP BY m, i""",
    "reference_centroid_drift": f"""{_reference_sql()}, a AS (SELECT m, i, avg(x) AS a, count(*) AS n FROM x GROUP BY ALL),
      c AS (SELECT m, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v WHERE label < 5), b AS (SELECT m, i, avg(x) AS b, count(*) AS n FROM c GROUP BY ALL),
      r AS (SELECT m, max(a.n) AS n1, max(b.n) AS n2, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS s FROM a JOIN b USING (m, i) GROUP BY m)
      SELECT m AS model_id, n1 AS n_reference, n2 AS n_current, round(s, 6) AS score, s > 0.1 AS drift FROM r""",
}
