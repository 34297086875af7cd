import pytest
from pyspark.sql import functions as F

from spanloom.plans import filters, guard, search
from spanloom.sources import otlp


@pytest.fixture(scope="module")
def traces(spark):
    rows = [("a", "m1", "u1", "api", "ok", 5.0, 10, "Hello World"), ("b", "m2", "u2", "web", "error", 50.0, 20, "other"), ("c", "m1", None, "api", "ok", 500.0, 30, None)]
    frame = spark.createDataFrame(rows, "trace_id string, model_id string, user_id string, service_name string, status string, latency_ms double, input_tokens long, input_preview string")
    return frame.withColumn("timestamp", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))


def ids(frame):
    return sorted(r.trace_id for r in frame.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("model_id = m1 AND latency_ms > 10", ["c"]),
        ("model_id = m2 OR latency_ms >= 500 AND status = ok", ["b", "c"]),
        ("user_id IS NULL", ["c"]),
        ("user_id IS NOT NULL AND service_name IN (api, web)", ["a", "b"]),
        ("input_tokens NOT BETWEEN 15 AND 25", ["a", "c"]),
        ("service_name LIKE 'a%' AND trace_id <> 'a'", ["c"]),
    ],
)
def test_filters(traces, text, want):
    assert ids(traces.where(filters.parse(text))) == want


@pytest.mark.parametrize("text", ["", "password = x", "latency_ms > fast", "model_id =", "model_id ~ x", "model_id = x; DROP", "model_id = a b", "a" * 2000])
def test_refused_filters(text):
    with pytest.raises(filters.FilterError):
        filters.parse(text)


@pytest.mark.parametrize(
    ("query", "want"),
    [("service:api", ["a", "c"]), ("model:m1 duration:>100", ["c"]), ("status:ERROR", ["b"]), ("duration:<10 time:last-24h", ["a"]), ("hello", ["a"]), ("has:drift", []), ("", ["a", "b", "c"])],
)
def test_search(traces, query, want):
    assert ids(search.search(traces, query)) == want


def test_guard_lets_queries_through(spark, traces):
    sql = "WITH t AS (SELECT * FROM traces) SELECT model_id, uniqExact(user_id) AS n, length('countIf(') AS k FROM t GROUP BY model_id"
    got = {r.model_id: (r.n, r.k) for r in guard.run(spark, {"traces": traces}, sql).collect()}
    assert got == {"m1": (1, 8), "m2": (1, 8)}
    assert guard.run(spark, {"traces": traces}, "SELECT trace_id FROM traces WHERE model_id = :m", m="m2").first().trace_id == "b"
    more = """WITH a AS (SELECT * FROM Traces), b AS (SELECT x.trace_id FROM a x JOIN A y ON x.trace_id = y.trace_id)
        SELECT count(*) AS n, quantiles(0, 1)(k) AS q, max(d) AS d FROM (SELECT 1 AS k, toDayOfWeek(timestamp) AS d FROM b JOIN traces t USING (trace_id)
        WHERE trace_id IN (SELECT trace_id FROM b UNION SELECT trace_id FROM a) GROUP BY trace_id, timestamp HAVING count(*) > 0 ORDER BY trace_id LIMIT 9) ORDER BY n LIMIT 5"""
    row = guard.run(spark, {"traces": traces}, more).first()
    assert (row.n, row.q, row.d) == (3, [1.0, 1.0], 2)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM secrets",
        "SELECT * FROM traces JOIN secrets USING (model_id)",
        "SELECT * FROM traces WHERE model_id IN (SELECT x FROM secrets)",
        "SELECT (SELECT max(x) FROM secrets) FROM traces",
        "SELECT * FROM parquet.`/etc`",
        "SELECT java_method('java.lang.System', 'exit') FROM traces",
        "SELECT * FROM traces; DROP TABLE traces",
        "DROP TABLE traces",
        "INSERT INTO traces SELECT * FROM traces",
        "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x",
        "SELEC 1",
        "WITH `parquet./any/file` AS (SELECT 1) SELECT * FROM parquet.`/any/file`",
        "WITH `parquet./any/file` AS (SELECT 1) SELECT * FROM `parquet`.`/any/file`",
        "SELECT * FROM (WITH secrets AS (SELECT 1) SELECT * FROM secrets) JOIN secrets",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "WITH RECURSIVE a AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM a) SELECT * FROM a",
        "SELECT * FROM range(5)",
        "SELECT * FROM traces, range(1000000)",
        "SELECT * FROM traces, LATERAL (SELECT * FROM secrets)",
        "SELECT * FROM traces LATERAL VIEW explode(array(1)) AS x",
        "SELECT * FROM VALUES (1), (2)",
        "SELECT * FROM IDENTIFIER('secrets')",
        "SELECT * FROM traces TABLESAMPLE (10 PERCENT)",
        "SELECT * FROM spans",
        "SELECT * FROM spark_catalog.default.traces",
        "TABLE traces",
        "SELECT trace_id FROM traces WHERE EXISTS (SELECT * FROM parquet.`/etc`)",
        "FROM traces |> SELECT trace_id",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM traces",
        "SELECT trace_id FROM traces WHERE IDENTIFIER('java_' || 'method')('java.lang.System', 'getProperty', 'user.home') = 'x'",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM traces",
        "SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'a')) FROM traces",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'a') FROM traces",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'a') FROM traces",
        "SELECT count(*) FILTER (WHERE reflect('a', 'b', 'c') = '') FROM traces",
        "SELECT sum(latency_ms) OVER (ORDER BY reflect('a', 'b', 'c')) FROM traces",
        "SELECT a.trace_id FROM traces a, traces b, traces c, traces d",
        "SELECT a.trace_id FROM traces a CROSS JOIN traces b",
        "SELECT trace_id FROM traces) UNION (SELECT 1",
        "SELECT * FROM traces -- ;\n; DROP VIEW traces",
        "SELECT /* */ toString(reflect('a', 'b', 'c')) FROM traces",
    ],
)
def test_guard_refuses(spark, traces, sql):
    with pytest.raises(guard.QueryRefused):
        guard.run(spark, {"traces": traces}, sql)


def test_guard_rewrites_nested_calls(spark, traces):
    sql = """SELECT toString(round(toFloat64(latency_ms), 1)) AS a, multiIf(latency_ms > 100, 'slow', latency_ms > (10 + 5), 'fair', "quick") AS b, 'toString(x)' AS c, -- toString(
        length(concat_free) AS n FROM (SELECT *, lower(input_preview) AS concat_free FROM traces) ORDER BY trace_id;"""
    rows = guard.run(spark, {"traces": traces}, sql).collect()
    assert [tuple(r) for r in rows] == [("5.0", "quick", "toString(x)", 11), ("50.0", "fair", "toString(x)", 5), ("500.0", "slow", "toString(x)", None)]
    sql = "SELECT quantile(0.5)(abs(0 - latency_ms)) AS q, quantiles(0, 1)(round(latency_ms)) AS qs, uniqExact(lower(model_id)) AS u, avgIf(abs(latency_ms), status = 'ok') AS v, sumIf(input_tokens, status IN ('ok', 'x')) AS t FROM traces"
    assert tuple(guard.run(spark, {"traces": traces}, sql).first()) == (50.0, [5.0, 500.0], 2, 252.5, 40)
    kinds = """SELECT model_id, row_number() FROM traces"""
    with pytest.raises(guard.QueryRefused):
        guard.run(spark, {"traces": traces}, kinds)
    wide = """SELECT status, model_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY status ORDER BY model_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k,
        count(*) FILTER (WHERE latency_ms BETWEEN 1 AND 9 OR trace_id LIKE 'c%' OR user_id IS NULL) AS f, CASE status WHEN 'ok' THEN -1 ELSE 1 % 2 END AS c,
        max(timestamp) + INTERVAL 1 DAY AS d, max(model_id || '-' || status) AS m FROM traces GROUP BY ROLLUP (status, model_id)"""
    assert guard.run(spark, {"traces": traces}, wide).count() == 5


def test_guard_leaves_views_alone_and_refuses_foreign_code(spark, traces):
    spark.range(3).createOrReplaceTempView("traces")
    assert guard.run(spark, {"traces": traces}, "SELECT trace_id FROM traces").count() == 3
    assert spark.table("traces").columns == ["id"] and len([t for t in spark.catalog.listTables() if t.name.startswith("guarded")]) == 0
    spark.catalog.dropTempView("traces")
    joined = "SELECT a.trace_id, t.n FROM traces a, (SELECT count(*) AS n FROM traces) t"
    assert guard.run(spark, {"traces": traces}, joined).count() == 3
    assert guard.run(spark, {"traces": traces}, "SELECT a.trace_id FROM traces a, traces b WHERE a.trace_id = b.trace_id").count() == 3
    other = spark.newSession()
    other.udf.register("weekday", lambda x: 1, "int")
    with pytest.raises(guard.QueryRefused, match="PythonUDF"):
        guard.run(other, {"traces": other.range(3)}, "SELECT weekday(id) FROM traces")


def test_queue_messages_in_either_form(spark):
    one = '{"traceId": "t1", "spanId": "s1", "name": "n", "status": {"code": 2}, "startTimeUnixNano": "1000", "endTimeUnixNano": 4000}'
    many = '{"spans": [{"trace_id": "t2", "span_id": "s2", "status": {"code": "STATUS_CODE_OK"}}, {"trace_id": "t3"}]}'
    messages = spark.createDataFrame([(one,), (many,), ("{broken",), ("[]",)], "value string")
    got = {r.trace_id: (r.span_id, r.status, r.duration_ns) for r in otlp.decode_batches(messages).collect()}
    assert got == {"t1": ("s1", "error", 3000), "t2": ("s2", "ok", None), "t3": (None, "unset", None)}
    assert {(r.message, r.reason, r.spans) for r in otlp.refused_batches(messages).collect()} == {("{broken", "no JSON", 0), ("[]", "no trace", 1)}
    mixed = '{"spans": [{"trace_id": "t4"}, {"span_id": "lost"}, {}]}'
    odd = spark.createDataFrame([(mixed,), ('{"spans": [{}]}',), (None,), ('{"a": ' + "[" * 40 + "]" * 40 + "}",), ('{"spans": [' + ",".join(['{"traceId": "x"}'] * 10_001) + "]}",)], "value string")
    assert [r.trace_id for r in otlp.decode_batches(odd).collect()] == ["t4"]
    assert sorted((r.reason, r.spans) for r in otlp.refused_batches(odd).collect()) == [
        ("no message", 0), ("no trace", 1), ("some spans without a trace", 2), ("too deep", 0), ("too many items", 0)
    ]


def test_values_of_all_kinds_repeated_keys_and_depth(spark):
    attributes = '[{"key": "a", "value": {"stringValue": "x"}}, {"key": "a", "value": {"intValue": "7"}}, {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}, {"key": "b", "value": {"bytesValue": "AQI="}}]'
    text = '{"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "attributes": ' + attributes + "}]}]}]}"
    row = otlp.flatten(spark.createDataFrame([(text,)], "value string")).first()
    assert row.attributes == {"a": "7", "l": '{"values":[{"intValue":"1"}]}', "b": "AQI="}
    deep = [("[" * n + '"]]' + "{" * 50 + '\\\\"' + "]" * n,) for n in (1, 32, 33, 60)]
    got = spark.createDataFrame(deep, "v string").select(otlp.too_deep(F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == [False, False, True, True]


def export(value, attributes=1):
    import json

    span = {"traceId": "t", "spanId": "s", "attributes": [{"key": f"k{i}", "value": {"stringValue": value}} for i in range(attributes)]}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [span]}]}]})


def depth(text):
    """How deep brackets outside strings are nested, character by character."""
    now = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            escaped, inside = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def test_escaped_quotes_and_brackets_in_strings_are_no_depth(spark):
    import json
    import random

    mark = random.Random(4)
    values = ['a "[" b', 'x"[', "\\", '\\"', "[" * 50, '"{' * 40, "\\" * 7 + '"' + "{" * 60, "é\n\t[" * 40, '\\"' * 100_000]
    values += ["".join(mark.choice('a"\\[]{}, ') for _ in range(mark.randrange(90))) for _ in range(150)]
    texts = [export(v) for v in values] + [json.dumps([export(v)] * 2) for v in values[:20]]
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.attributes["k0"] for r in otlp.flatten(messages).collect()) == sorted(values)
    got = messages.select("value", otlp.too_deep(F.col("value"), 8).alias("d")).collect()
    assert all(r.d == (depth(r.value) > 8) for r in got)


def test_every_refused_message_is_counted(spark):
    deep = '{"resourceSpans": ' + "[" * 33 + "]" * 33 + "}"
    texts = [export("good"), None, "{broken", deep, export("x" * otlp.MOST_BYTES + "x"), export("x" * 1000, 1500), export("v", otlp.MOST_ITEMS + 1), export("v", otlp.MOST_ITEMS // 100)]
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    assert otlp.flatten(messages).count() == 3
    assert sorted(r.reason for r in otlp.refused(messages).collect()) == ["no JSON", "no message", "too deep", "too long", "too many items"]
    assert otlp.corrupt(messages).count() == 5 and otlp.refused(messages, kind="logs").count() == 4 and otlp.refused(messages, kind="metrics").count() == 4
