"""Alert rules over metric points (key, timestamp, seq, x), suppression and grouping of events."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.sequential import in_order, streak
from spanloom.session import Workspace

_MICROS = 1_000_000


def _micros(column: str = "timestamp") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _cut(rows: DataFrame, seconds: int, by: tuple[str, ...] = ("key",), reach: Column | None = None) -> DataFrame:
    """Rows by ``by`` and span of time, each also in the span after its own, where ``_own`` is false.

    A frame of so many seconds then lies within one span, so a key is no longer one task.  ``_sh`` is a row's time, or
    for a row of the span before the last time at which a frame still reaches it.  Rows without ``reach`` stay in their span.
    """
    rows = rows.withColumn("_at", _micros())
    own = F.floor(F.col("_at") / (seconds * _MICROS))
    spans = F.array(F.struct(own.alias("span"), F.lit(True).alias("own")), F.struct((own + 1).alias("span"), F.lit(False).alias("own")))
    out = rows.select("*", F.explode(spans).alias("_part")).select("*", F.col("_part.span").alias("_span"), F.col("_part.own").alias("_own")).drop("_part")
    reached = F.col("_at").isNotNull() if reach is None else F.col("_at").isNotNull() & reach
    out = out.where(F.col("_own") | reached).withColumn("_sh", F.when(F.col("_own"), F.col("_at")).otherwise(F.col("_at") + seconds * _MICROS))
    return out.repartition(*by, "_span")


def _halves(by: tuple[str, ...] = ("key",)) -> list:
    """(window, rows that count) for both parts of a frame over what :func:`_cut` gives.

    A frame is as long as a span: it is an end of the span before, and a beginning of its own.  Both only grow
    along their order, so a row costs the same however many rows its frame has, and nothing is taken off a sum again.
    """
    spans = Window.partitionBy(*by, "_span")
    return [(spans.orderBy(F.desc("_sh")), ~F.col("_own")), (spans.orderBy("_sh"), F.col("_own"))]


def moments(rows: DataFrame, seconds: int, by: tuple[str, ...] = ("key",), reach: Column | None = None) -> DataFrame:
    """``rows`` with ``n`` rows, ``k`` values, mean ``m`` and deviation ``s`` of the last seconds, the row and its peers included.

    Rows without ``reach`` get those of their span alone, as does :func:`starts`.
    """
    out = _cut(rows, seconds, by, reach)
    parts = {}
    for i, (frame, mine) in enumerate(_halves(by)):
        x = F.when(mine, F.col("x").cast("double"))
        parts |= {name: c.over(frame) for name, c in {f"_n{i}": F.count_if(mine), f"_k{i}": F.count(x), f"_m{i}": F.avg(x), f"_v{i}": F.var_pop(x), f"_lo{i}": F.min(x), f"_hi{i}": F.max(x)}.items()}
    out = out.select(*rows.columns, "_own", *(c.alias(name) for name, c in parts.items())).where("_own")
    k = F.col("_k0") + F.col("_k1")
    part = lambda name: F.coalesce(name, F.lit(0.0))
    mean = F.try_divide(F.col("_k0") * part("_m0") + F.col("_k1") * part("_m1"), k)
    apart = F.coalesce(F.col("_m0") - F.col("_m1"), F.lit(0.0))
    spread = F.col("_k0") * part("_v0") + F.col("_k1") * part("_v1") + apart * apart * F.try_divide(F.col("_k0") * F.col("_k1"), k)
    # Equal values deviate by nothing, whatever their means round to.
    low, high = F.least("_lo0", "_lo1"), F.greatest("_hi0", "_hi1")
    s = F.when((low == high) & (F.abs(low) < float("inf")), 0.0).otherwise(F.sqrt(F.try_divide(spread, k)))
    return out.select(*rows.columns, (F.col("_n0") + F.col("_n1")).alias("n"), k.alias("k"), F.when(k > 0, mean).alias("m"), s.alias("s"))


def starts(rows: DataFrame, seconds: int, by: tuple[str, ...] = ("key",), reach: Column | None = None) -> DataFrame:
    """``rows`` with ``_at``, and time ``at0`` and value ``x0`` of the first row of the last seconds."""
    out = _cut(rows, seconds, by, reach)
    (before, old), (upto, own) = _halves(by)
    place = F.struct("_at", "seq")
    first = lambda mine, frame: (F.min(F.when(mine, F.col("_at"))).over(frame), F.min_by("x", F.when(mine, place)).over(frame))
    (a0, x0), (a1, x1) = first(old, before), first(own, upto)
    out = out.select(*rows.columns, "_at", "_own", a0.alias("_a0"), x0.alias("_x0"), a1.alias("_a1"), x1.alias("_x1")).where("_own")
    earlier = F.col("_a0").isNotNull()
    return out.select(*rows.columns, "_at", F.coalesce("_a0", "_a1").alias("at0"), F.when(earlier, F.col("_x0")).otherwise(F.col("_x1")).alias("x0"))


#: Values that differ by less are equal.
EQUAL = 1e-9

#: Comparisons of threshold rules by name.
COMPARISONS = {
    ">": lambda x, limit: x > limit,
    ">=": lambda x, limit: x >= limit,
    "<": lambda x, limit: x < limit,
    "<=": lambda x, limit: x <= limit,
    "==": lambda x, limit: F.abs(x - limit) < EQUAL,
    "!=": lambda x, limit: F.abs(x - limit) >= EQUAL,
}


def threshold(rows: DataFrame, limit: float, consecutive: int, comparison: str = ">") -> DataFrame:
    """Points that end a run of at least ``consecutive`` values beyond the limit."""
    return streak(rows, COMPARISONS[comparison](F.col("x"), limit)).where(F.col("streak") >= consecutive).select("key", "seq", "streak")


def anomaly(rows: DataFrame, z: float = 3.0, least: int = 100, hours: int = 24, direction: str = "both") -> DataFrame:
    """Points more than ``z`` standard deviations from the mean of the last hours, which include them.

    ``direction`` is up, down or both.
    """
    beyond = {"up": lambda s: s > z, "down": lambda s: s < -z, "both": lambda s: F.abs(s) > z}[direction]
    out = moments(rows.select("key", "timestamp", "seq", "x"), hours * 3600)
    score = (F.col("x") - F.col("m")) / F.col("s")
    return out.where((F.col("n") >= least) & (F.col("s") > 0)).withColumn("z", score).where(beyond(F.col("z"))).select("key", "seq", F.round("z", 6).alias("z"))


def rate(rows: DataFrame, per_second: float, seconds: int = 300, percent: bool = False) -> DataFrame:
    """Points where the value changes faster than ``per_second`` within the window before them.

    With ``percent`` the change counts in hundredths of the window's first value; from 0 it has none.
    """
    out = starts(rows.select("key", "timestamp", "seq", "x"), seconds)
    speed = (F.col("x") - F.col("x0")) / ((F.col("_at") - F.col("at0")) / _MICROS)
    speed = F.try_divide(100 * speed, F.abs("x0")) if percent else speed
    return out.where("_at > at0").withColumn("rate", speed).where(F.abs("rate") > per_second).select("key", "seq", F.round("rate", 6).alias("rate"))


def _over_last(rows: DataFrame, size: int, least: int, shape: Callable, kind: str) -> DataFrame:
    """(key, seq, value): ``shape(v, n)`` of every row that has ``least`` values or more among its last ``size`` rows.

    ``v`` has the values of a row at its right end, ``n`` says how many; nulls are no values.  Rows without a shape are
    left out.  Rows are dealt by ranges of key and time, so a key is not one task.  Frames are whole within a range but
    for the first rows of its first key: these are kept with the last rows of every range, a few each, and get theirs
    from both.
    """
    back = size - 1
    types = {c: rows.schema[c].dataType.simpleString() for c in ("key", "timestamp", "seq")}
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + f", x double, edge string, value {kind}"

    def run(batches: Iterator[pa.RecordBatch], ranges: bool) -> Iterator[pa.RecordBatch]:
        held, first, seen = None, True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table, h = (new, 0) if held is None else (pa.concat_tables([held, new]), held.num_rows)
            codes = table["key"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            runs = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            start = np.repeat(runs, np.diff(np.append(runs, len(codes))))
            at = np.arange(h, len(codes))
            own = start[h:] == 0  # rows of the key that the batch before ended with
            head = own & (seen + at - h < back) if ranges and first else np.zeros(len(at), bool)
            seen, first = seen + int(own.sum()), first and bool(own.all())
            known = np.append(np.zeros(back, bool), table["x"].is_valid().to_numpy())
            x = np.append(np.zeros(back), table["x"].fill_null(0.0).to_numpy())
            valid = sliding_window_view(known, size)[h:] & (at[:, None] - back + np.arange(size) >= start[h:, None])
            n = valid.sum(1)
            wanted = (n >= least) & (~head if ranges else pc.equal(table["edge"].slice(h), "first").to_numpy())
            valid, n = valid[wanted], n[wanted]
            v = np.where(valid, sliding_window_view(x, size)[h:][wanted], 0.0)
            gaps = (valid[:, :-1] & ~valid[:, 1:]).any(1)
            v[gaps] = np.take_along_axis(v[gaps], np.argsort(valid[gaps], axis=1, kind="stable"), 1)
            with np.errstate(all="ignore"):
                value = shape(v, n)
            yield from made(table.take(at[wanted]), "", value)
            if ranges:
                yield from made(table.take(at[head]), "first", None)
            held = table.slice(max(int(start[-1]), len(codes) - back))
        if ranges and held is not None:  # those among them that were given as first rows stand there already
            yield from made(held.slice(max(0, back - (seen - held.num_rows))) if first else held, "last", None)

    def made(table: pa.Table, edge: str, value: pa.Array | None) -> Iterator[pa.RecordBatch]:
        done = not edge
        out = {c: pa.nulls(len(table), table[c].type) if done and c in ("timestamp", "x") else table[c] for c in ("key", "timestamp", "seq", "x")}
        value = pa.nulls(len(table), pa.string() if kind == "string" else pa.float64()) if value is None else value
        out = pa.table(out | {"edge": pa.array([edge] * len(table), pa.string()), "value": value})
        yield from (out.filter(pc.is_valid(out["value"])) if done else out).to_batches()

    ranges = rows.select("key", "timestamp", "seq", F.col("x").cast("double").alias("x")).repartitionByRange("key", "timestamp", "seq").sortWithinPartitions("key", "timestamp", "seq")
    # Both uses must see the same ranges.
    saved = Workspace(rows.sparkSession, "last").save(ranges.mapInArrow(lambda b: run(b, True), schema), "ranges")
    edges = saved.where("edge <> ''").repartition("key").sortWithinPartitions("key", "timestamp", "seq").mapInArrow(lambda b: run(b, False), schema)
    return saved.where("edge = ''").select("key", "seq", "value").unionByName(edges.select("key", "seq", "value"))


def patterns(rows: DataFrame, size: int = 20, least: int = 10) -> DataFrame:
    """Shapes of the last values: a spike or dip at the end, a step between halves, or a steady trend."""

    def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a > b as Spark has it: nothing is greater than NaN, which is greater than all else."""
        return (a > b) | (np.isnan(a) & ~np.isnan(b))

    def shape(v: np.ndarray, n: np.ndarray) -> pa.Array:
        place = np.arange(size) - (size - n[:, None])
        half = n // 2
        # Column by column, so that sums are those of the values in their order.
        total = lambda values, mine: reduce(lambda s, j: np.where(mine[:, j], s + values[:, j], s), range(size), np.zeros(len(n)))
        before = (place >= 0) & (place < n[:, None] - 1)
        m = total(v, before) / (n - 1)
        sd = np.sqrt(total((v - m[:, None]) * (v - m[:, None]), before) / (n - 1))
        m1 = total(v, (place >= 0) & (place < half[:, None])) / half
        m2 = total(v, place >= half[:, None]) / (n - half)
        ups = ((place[:, 1:] >= 1) & above(v[:, 1:], v[:, :-1])).sum(1)
        spread = (n > 1) & above(sd, np.zeros(len(n)))
        kinds = {
            "spike": spread & above(v[:, -1], m + 3 * sd),
            "dip": spread & above(m - 3 * sd, v[:, -1]),
            "step": spread & above(np.abs(m2 - m1), 2 * sd),
            "rise": ups >= 0.8 * (n - 1),
            "fall": ups <= 0.2 * (n - 1),
        }
        return pa.array(np.select(list(kinds.values()), list(kinds), ""), pa.string(), mask=~np.any(list(kinds.values()), axis=0))

    return _over_last(rows, size, least, shape, "string").withColumnRenamed("value", "pattern")


def oscillation(rows: DataFrame, size: int = 20, least: int = 10, sensitivity: float = 0.8) -> DataFrame:
    """Points whose last values turn more often than ``sensitivity`` of the times they could."""

    def shape(v: np.ndarray, n: np.ndarray) -> pa.Array:
        step = np.diff(v, axis=1)
        inside = np.arange(2, size) - (size - n[:, None]) >= 2
        turns = (inside & (step[:, 1:] * step[:, :-1] < 0)).sum(1) / (n - 2)
        return pa.array(turns, mask=~(turns > sensitivity - 1e-6))

    out = _over_last(rows, size, least, shape, "double")
    return out.withColumn("turns", F.round("value", 8)).where(F.col("turns") > sensitivity).select("key", "seq", "turns")


def composite(children: dict[str, DataFrame], every: bool) -> DataFrame:
    """Points (key, seq) at which all, or any, of the rules fire, with the names of those that do."""
    fired = None
    for name, rows in children.items():
        one = rows.select("key", "seq", F.lit(name).alias("rule"))
        fired = one if fired is None else fired.unionByName(one)
    out = fired.groupBy("key", "seq").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.count_distinct("rule").alias("n"))
    return (out.where(F.col("n") == len(children)) if every else out).select("key", "seq", "rules")


def fingerprint(rule: Column, metric: Column, labels: dict[str, Column]) -> Column:
    """A code of rule, metric and sorted labels."""
    parts = [F.concat(F.lit(f"{name}="), value) for name, value in sorted(labels.items())]
    return F.md5(F.concat_ws("|", rule, metric, *parts))


def deduplicate(events: DataFrame, minutes: int = 5) -> DataFrame:
    """(fingerprint, timestamp, seq): an event is new if none like it came in the last minutes.

    The window slides: a duplicate keeps it open.  ``episode`` numbers the new ones of a fingerprint.
    """
    ordered = Window.partitionBy("fingerprint").orderBy("timestamp", "seq")
    gap = _micros() - F.lag(_micros()).over(ordered)
    new = gap.isNull() | (gap >= minutes * 60 * _MICROS)
    out = events.withColumn("is_new", new)
    return out.withColumn("episode", F.count_if("is_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def suppress(events: DataFrame, silences: DataFrame) -> DataFrame:
    """Events that no silence covers; a silence has start, stop and matchers, a map of label values.

    A matcher on a label that an event lacks is no obstacle.  Silences are a small table made by hand.
    """
    s = silences.select("start", "stop", "matchers")
    agree = F.forall(F.map_entries("matchers"), lambda m: F.coalesce(F.try_element_at("labels", m["key"]) == m["value"], F.lit(True)))
    covered = (F.col("timestamp") >= F.col("start")) & (F.col("timestamp") < F.col("stop")) & agree
    return events.join(F.broadcast(s), covered, "left_anti")


def process(events: DataFrame, minutes: int = 5, limits: dict[float, int] | None = None) -> DataFrame:
    """What becomes of each event (key, timestamp, seq, fingerprint, maintenance, silenced), in order of time.

    Per key: when as many new alerts went out as a limit allows in its seconds, an event is rate limited;
    then maintenance and silences suppress it; then one like it in the last minutes makes it a duplicate,
    which keeps the window open.  What is left is new, and counts for the limits.  The state is the times
    within the longest limit and the fingerprints within the window.
    """
    limits = limits or {60.0: 60, 3600.0: 500}

    def step(state: dict, frame: pd.DataFrame) -> pd.DataFrame:
        sent, seen, out = state["sent"], state["seen"], []
        times = frame["timestamp"].to_numpy("datetime64[us]").astype("int64") / 1e6
        for now, mark, kept, quiet in zip(times, frame["fingerprint"], frame["maintenance"], frame["silenced"], strict=True):
            while sent and now - sent[0] > max(limits):
                sent.popleft()
            if now - state["swept"] > 60 * minutes:
                for old in [m for m, t in seen.items() if now - t >= 60 * minutes]:
                    del seen[old]
                state["swept"] = now
            if any(sum(now - t <= width for t in sent) >= most for width, most in limits.items()):
                out.append("rate limited")
            elif kept:
                out.append("maintenance")
            elif quiet:
                out.append("silenced")
            else:
                duplicate = now - seen.get(mark, -math.inf) < 60 * minutes
                seen[mark] = now
                out.append("duplicate" if duplicate else "new")
                if not duplicate:
                    sent.append(now)
        return pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "outcome": out})

    start = lambda: {"sent": deque(), "seen": {}, "swept": -math.inf}
    return in_order(events, start, step, "key string, seq long, outcome string")


def covered(events: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """``events`` with a flag: whether one of the windows (see :func:`suppress`) covers them."""
    free = suppress(events.select("seq", "timestamp", "labels"), windows).select("seq", F.lit(False).alias("_free"))
    return events.join(free, "seq", "left").withColumn(name, F.col("_free").isNull()).drop("_free")


def groups(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events by keys: how many, the highest severity and the span of time."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("severity_rank").alias("severity_rank"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def auto_resolve(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Last event of each fingerprint's episode, and when it resolves itself."""
    last = deduplicate(events, minutes).groupBy("fingerprint", "episode").agg(F.max("timestamp").alias("last_at"), F.count("*").alias("n"))
    return last.withColumn("resolved_at", F.expr(f"last_at + INTERVAL {minutes} MINUTES"))


def notifications(events: DataFrame, template: str, floor: int) -> DataFrame:
    """Rendered texts of events at or above a severity; ``{{name}}`` stands for a column."""
    text = F.lit(template)
    for name in events.columns:
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return events.where(F.col("severity_rank") >= floor).select("seq", text.alias("payload"))
