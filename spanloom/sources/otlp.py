"""Decoding of telemetry messages: nested span exports, and batches of spans from a queue.

Schemas are explicit; both camelCase and snake_case keys are read.  Every message that is refused, by whatever
limit, is a row of :func:`refused` with the reason, so that nothing is lost uncounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a string of a message; one with a longer string is refused, as beyond the limits below.
MOST_BYTES = 1 << 20

#: How deep a message may be nested.
MOST_DEPTH = 32

#: How long a list of resources, scopes, spans, points, records or attributes may be.
MOST_ITEMS = 10_000

# Lists, maps and bytes are kept as their JSON text.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = (
    f"struct<traceId:string,trace_id:string,spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,name:string,kind:string,"
    f"startTimeUnixNano:string,start_time_unix_nano:string,endTimeUnixNano:string,end_time_unix_nano:string,"
    f"status:struct<code:string,message:string>,attributes:{_ATTRIBUTES}>"
)
EXPORT = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string>,spans:array<{_SPAN}>>>>>"
# Codes stand as numbers or as names.
_STATUS = {"0": "unset", "1": "ok", "2": "error", "STATUS_CODE_OK": "ok", "STATUS_CODE_ERROR": "error", "STATUS_CODE_UNSET": "unset"}


def _map(attributes: Column) -> Column:
    """Attributes as a map of strings, whatever type a value has."""
    valid = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull())
    names, texts = F.transform(valid, lambda a: a["key"]), F.transform(valid, lambda a: _text(a["value"]))
    keys = F.array_distinct(names)
    # A key that is repeated has its last value.
    last = lambda k: (F.size(names) + 1 - F.array_position(F.reverse(names), k)).cast("int")
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(texts, last(k))))


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["arrayValue"], v["kvlistValue"], v["bytesValue"])


def _time(nanos: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


#: A string of JSON, escaped quotes and backslashes included; an open one reaches to the end.
_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)'


def _pairs(levels: int) -> str:
    """Pairs of brackets that hold none but such pairs, ``levels`` deep at most."""
    inner = f"(?:{_pairs(levels - 1)})*+" if levels > 1 else ""
    return rf"\[{inner}\]|\{{{inner}\}}"


def too_deep(text: Column, most: int = MOST_DEPTH) -> Column:
    """Whether brackets outside strings are nested deeper than ``most``: innermost pairs go, four levels at a time."""
    left = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]++", "")
    for levels in [4] * (most // 4) + [most % 4] * (most % 4 > 0):
        left = F.regexp_replace(left, _pairs(levels), "")
    return F.length(left) > 0


def _status(code: Column) -> Column:
    out = F
    for raw, name in _STATUS.items():
        out = out.when(code == raw, name)
    return out.otherwise(F.lower(F.coalesce(code, F.lit("unset"))))


def _fields(span: str) -> list[Column]:
    s = F.col(span)
    both = lambda camel, snake: F.coalesce(s[camel], s[snake])
    start = both("startTimeUnixNano", "start_time_unix_nano").try_cast("long")
    end = both("endTimeUnixNano", "end_time_unix_nano").try_cast("long")
    return [
        both("traceId", "trace_id").alias("trace_id"),
        both("spanId", "span_id").alias("span_id"),
        F.coalesce(both("parentSpanId", "parent_span_id"), F.lit("")).alias("parent_span_id"),
        s["name"].alias("span_name"),
        F.lower(s["kind"]).alias("span_kind"),
        start.alias("start_ns"),
        (end - start).alias("duration_ns"),
        _time(start).alias("start_time"),
        _status(s["status"]["code"]).alias("status"),
        _map(s["attributes"]).alias("attributes"),
    ]


def _lists(kind: str) -> list[str]:
    """Paths of the lists of a message of this kind, outer ones first."""
    return {"spans": ["resourceSpans", "scopeSpans", "spans"], "metrics": ["resourceMetrics", "scopeMetrics", "metrics"], "logs": ["resourceLogs", "scopeLogs", "logRecords"]}[kind]


def _longest(message: Column, kind: str) -> Column:
    """Items of the longest list; nested ones by level."""
    outer, middle, inner = _lists(kind)
    size = lambda x: F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0))
    most = lambda xs, f: F.coalesce(F.array_max(F.transform(xs, f)), F.lit(0))
    of_item = lambda i: F.greatest(*(size(i[k]["dataPoints"]) for k in ("gauge", "sum", "histogram"))) if kind == "metrics" else size(i["attributes"])
    of_middle = lambda m: F.greatest(size(m[inner]), most(m[inner], of_item))
    of_outer = lambda o: F.greatest(size(o[middle]), size(o["resource"]["attributes"]), most(o[middle], of_middle))
    return F.greatest(size(message[outer]), most(message[outer], of_outer))


def _long_string(text: Column) -> Column:
    strings = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    return F.when(F.octet_length(text) > MOST_BYTES, F.exists(strings, lambda x: F.octet_length(x) > MOST_BYTES + 2)).otherwise(False)


def _outside(text: Column) -> Column:
    """Why a text must not be parsed; null where it may be."""
    return (
        F.when(text.isNull(), "no message")
        .when(_long_string(text), "too long")
        .when(F.get_json_object(text, "$").isNull(), "no JSON")
        .when(too_deep(text), "too deep")
    )


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with a column that is computed once a row: filters and further columns are not merged with an explode."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _parsed(messages: DataFrame, column: str, kind: str) -> DataFrame:
    schema = {"spans": EXPORT, "metrics": METRICS, "logs": LOGS}[kind]
    out = _once(messages.select(F.col(column).alias("_text")), _outside(F.col("_text")), "_reason")
    out = _once(out, F.from_json(F.when(F.col("_reason").isNull(), F.col("_text")), schema), "m")
    return _once(out, F.coalesce("_reason", F.when(_longest(F.col("m"), kind) > MOST_ITEMS, "too many items")), "reason").drop("_reason")


def refused(messages: DataFrame, column: str = "value", kind: str = "spans") -> DataFrame:
    """(message, reason) of every message of which nothing is taken; ``kind`` is spans, metrics or logs."""
    return _parsed(messages, column, kind).where("reason is not null").select(F.col("_text").alias("message"), "reason")


def flatten(messages: DataFrame, column: str = "value") -> DataFrame:
    """Spans of nested exports: resource, scope and span in one row each."""
    parsed = _parsed(messages, column, "spans").where("reason is null").select("m")
    resources = parsed.select(F.explode("m.resourceSpans").alias("r"))
    scopes = resources.select(_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("c"))
    spans = scopes.select("resource", F.col("c.scope.name").alias("scope"), F.explode("c.spans").alias("s"))
    return spans.select(F.try_element_at("resource", F.lit("service.name")).alias("service_name"), "scope", *_fields("s"))


def _batches(messages: DataFrame, column: str) -> DataFrame:
    """Messages of spans with ``spans``, what they hold, and ``reason``, why nothing is taken of them."""
    out = messages.select(F.col(column).alias("_text"), _outside(F.col(column)).alias("reason"))
    text = F.when(F.col("reason").isNull(), F.col("_text"))
    out = out.withColumn("spans", F.coalesce(F.from_json(text, f"spans array<{_SPAN}>")["spans"], F.array(F.from_json(text, _SPAN))))
    named = F.filter("spans", lambda s: F.coalesce(s["traceId"], s["trace_id"]).isNotNull())
    more = F.when(F.size("spans") > MOST_ITEMS, "too many items").when((F.size("spans") > 0) & (F.size(named) == 0), "no trace")
    nameless = F.when(F.col("reason").isNull(), F.size("spans") - F.size(named)).otherwise(0)
    return out.select("_text", named.alias("spans"), nameless.cast("long").alias("nameless"), F.coalesce("reason", more).alias("reason"))


def decode_batches(messages: DataFrame, column: str = "value") -> DataFrame:
    """Spans of queue messages: ``{"spans": [...]}`` or one span a message; spans without a trace are left out."""
    return _batches(messages, column).where("reason is null").select(F.explode("spans").alias("s")).select(*_fields("s"))


def refused_batches(messages: DataFrame, column: str = "value") -> DataFrame:
    """(message, reason, spans): queue messages refused as a whole, and those of whose spans some have no trace."""
    rows = _batches(messages, column).where("reason is not null or nameless > 0")
    return rows.select(F.col("_text").alias("message"), F.coalesce("reason", F.lit("some spans without a trace")).alias("reason"), F.col("nameless").alias("spans"))


def corrupt(messages: DataFrame, column: str = "value", kind: str = "spans") -> DataFrame:
    """Messages that are refused, as :func:`refused`, but without the reasons."""
    return refused(messages, column, kind).select(F.col("message").alias(column))


def kafka(spark, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The queue as a stream of ``value`` strings; needs Spark's Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return stream.option("startingOffsets", starting).option("maxOffsetsPerTrigger", 500_000).load().select(F.col("value").cast("string"))


_POINT = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double>"
_METRIC = f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<dataPoints:array<{_POINT}>>,histogram:struct<dataPoints:array<{_POINT}>>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>"
_RECORD = f"struct<timeUnixNano:string,severityText:string,severityNumber:int,body:{_VALUE},attributes:{_ATTRIBUTES},traceId:string,spanId:string>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<{_RECORD}>>>>>"


def _service(resource: str) -> Column:
    return F.coalesce(F.try_element_at(_map(F.col(resource)["attributes"]), F.lit("service.name")), F.lit("unknown")).alias("service_name")


def flatten_metrics(messages: DataFrame, column: str = "value") -> DataFrame:
    """One row a data point of gauges, sums and histograms (their sum, and count): name, kind, time, value, labels."""
    one = _parsed(messages, column, "metrics").where("reason is null").select(F.explode("m.resourceMetrics").alias("r"))
    one = one.select(F.col("r.resource").alias("resource"), F.explode("r.scopeMetrics").alias("s")).select("resource", F.explode("s.metrics").alias("m"))

    def of(kind: str) -> Column:
        points = F.coalesce(F.col(f"m.{kind}.dataPoints"), F.array().cast(f"array<{_POINT}>"))
        return F.transform(points, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))

    points = one.select("resource", "m.name", "m.unit", F.explode(F.concat(*map(of, ("gauge", "sum", "histogram")))).alias("x"))
    amount = F.coalesce("x.p.asDouble", F.col("x.p.asInt").try_cast("double"), "x.p.sum")
    at = _time(F.col("x.p.timeUnixNano").try_cast("long"))
    return points.select(_service("resource"), "name", "unit", "x.kind", at.alias("time"), amount.alias("amount"), F.col("x.p.count").try_cast("long").alias("count"), _map(F.col("x.p.attributes")).alias("labels"))


def flatten_logs(messages: DataFrame, column: str = "value") -> DataFrame:
    """One row a log record: service, time, severity, body as text, attributes and the span it belongs to."""
    one = _parsed(messages, column, "logs").where("reason is null").select(F.explode("m.resourceLogs").alias("r"))
    one = one.select(F.col("r.resource").alias("resource"), F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    at = _time(F.col("l.timeUnixNano").try_cast("long"))
    return one.select(_service("resource"), at.alias("time"), F.lower("l.severityText").alias("severity"), _text(F.col("l.body")).alias("body"), _map(F.col("l.attributes")).alias("attributes"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"))
