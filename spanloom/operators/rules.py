"""Alert rules and evaluators that are data: JSON is checked and compiled to one plan for all of them.

Windows by metric and key serve all rules of all kinds from one scan; rules are a small table that meets what comes
out of them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import alerts, evals
from spanloom.operators.references import _versions

# Names in rule files, and what a rule has that does not say.
KINDS = ("threshold", "anomaly", "rate", "pattern", "composite")
SEVERITIES = ("info", "warning", "error", "critical")
COMPARISONS = {
    "greater_than": ">",
    "greater_than_or_equal": ">=",
    "less_than": "<",
    "less_than_or_equal": "<=",
    "equal": "==",
    "not_equal": "!=",
}
DEFAULTS = {
    "threshold": {"metric_name": "", "comparison": "greater_than", "threshold": 0.0, "consecutive_count": 1},
    "anomaly": {"metric_name": "", "std_dev_threshold": 3.0, "min_samples": 100},
    "rate": {"metric_name": "", "rate_threshold": 0.0, "window_seconds": 300, "use_percentage": False},
    "pattern": {"metric_name": "", "sensitivity": 0.7},
    "composite": {"rule_ids": []},
}
ANOMALY_HOURS = 24
#: Conditions of thresholds on a metric that are followed side by side; where there are more, its points come in several blocks.
SLOTS = 32
_LIMITS = "array<struct<comparison:string,amount:double>>"
_WAITING = "array<struct<slot:int,count:long,rule_id:string,severity:string>>"
_OTHERS = "array<struct<kind:string,rule_id:string,severity:string,amount:double,count:long,seconds:long,percent:boolean>>"


def parse(text: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """(rules, refused): the rules of a JSON text that can run, and (rule_id, why) of the others.

    Unlike a lenient reader, which takes an unknown kind for a threshold, this one refuses what it does not know: kinds,
    severities, comparisons, settings of another type, settings that the kind does not have, missing
    or repeated ids, composites of no rules, of rules that are not there, or of themselves.
    """
    try:
        listed = json.loads(text)["rules"]
        if not isinstance(listed, list):
            raise TypeError
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("rules must be a JSON object with a list named rules") from error
    rules, refused = {}, []
    for n, raw in enumerate(listed):
        rule, why = _checked(raw)
        name = str(raw.get("rule_id") or f"#{n}") if isinstance(raw, dict) else f"#{n}"
        why = why or ("repeated id" if name in rules else None)
        if why:
            refused.append((name, why))
        else:
            rules[name] = rule
    while True:  # a composite goes when one of its rules has gone
        lost = {r["rule_id"]: missing for r in rules.values() if r["type"] == "composite" and (missing := sorted(set(r["config"]["rule_ids"]) - rules.keys()))}
        lost |= {i: ["itself"] for i in rules.keys() - lost.keys() if _turns(rules, i)}
        if not lost:
            return list(rules.values()), refused
        for i, missing in lost.items():
            refused.append((i, f"composite of unknown rules: {', '.join(missing)}"))
            del rules[i]


def _turns(rules: dict[str, dict], start: str) -> bool:
    """Whether a composite contains itself."""
    todo, seen = [start], set()
    while todo:
        for child in rules.get(todo.pop(), {"config": {}})["config"].get("rule_ids", ()):
            if child == start:
                return True
            if child not in seen:
                seen.add(child)
                todo.append(child)
    return False


def _checked(raw) -> tuple[dict | None, str | None]:
    if not isinstance(raw, dict):
        return None, "no object"
    rule = {"name": "", "description": "", "type": "threshold", "severity": "warning", "enabled": True} | raw
    if not isinstance(rule.get("rule_id"), str) or not rule["rule_id"]:
        return None, "no id"
    if not isinstance(rule["name"], str) or not rule["name"]:
        return None, "no name"
    if rule["type"] not in KINDS:
        return None, f"unknown type: {rule['type']}"
    if rule["severity"] not in SEVERITIES:
        return None, f"unknown severity: {rule['severity']}"
    if not isinstance(rule["enabled"], bool):
        return None, "enabled is no boolean"
    given, known = rule.get("config", {}), DEFAULTS[rule["type"]]
    if not isinstance(given, dict):
        return None, "config is no object"
    if extra := given.keys() - known.keys():
        return None, f"unknown settings: {', '.join(sorted(extra))}"
    for key, value in given.items():
        want = (int, float) if isinstance(known[key], float) else type(known[key])
        if not isinstance(value, want) or (isinstance(value, bool) and want is not bool):
            return None, f"wrong type: {key}"
    config = known | given
    if rule["type"] == "composite":
        if not config["rule_ids"] or not all(isinstance(i, str) for i in config["rule_ids"]):
            return None, "no rules to combine"
    elif not config["metric_name"]:
        return None, "no metric"
    if config.get("comparison", "equal") not in COMPARISONS:
        return None, f"unknown comparison: {config['comparison']}"
    if config.get("consecutive_count", 1) < 1 or config.get("window_seconds", 1) < 1:
        return None, "count or window under 1"
    return rule | {"config": config}, None


def _table(rules: list[dict]) -> list[tuple]:
    """(metric, block, conditions, rules that wait for runs of one of them, other rules): the latter in block 0."""
    limits: dict[str, dict[tuple, list]] = {}
    others: dict[str, list] = {}
    for r in rules:
        c = r["config"]
        waiting, rest = limits.setdefault(c["metric_name"], {}), others.setdefault(c["metric_name"], [])
        if r["type"] == "threshold":
            waiting.setdefault((COMPARISONS[c["comparison"]], float(c["threshold"])), []).append((c["consecutive_count"], r["rule_id"], r["severity"]))
        else:
            amount = c.get("std_dev_threshold", c.get("rate_threshold", c.get("sensitivity")))
            rest.append((r["type"], r["rule_id"], r["severity"], float(amount), c.get("min_samples"), c.get("window_seconds"), c.get("use_percentage")))
    out = []
    for metric, found in limits.items():
        listed = list(found.items())
        for first in range(0, max(len(listed), 1), SLOTS):
            part = listed[first : first + SLOTS]
            waiting = [(j, *rule) for j, (_, those) in enumerate(part) for rule in those]
            out.append((metric, first // SLOTS, [limit for limit, _ in part], waiting, [] if first else others[metric]))
    return out


def _violations(slots: int) -> Column:
    """A number whose bits say which of the row's conditions it violates; null violates none."""
    bad = lambda limit: reduce(lambda w, c: w.when(limit["comparison"] == c[0], c[1](F.col("x"), limit["amount"])), alerts.COMPARISONS.items(), F)
    bits = (F.when(bad(F.get("limits", F.lit(j))), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")) for j in range(slots))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def evaluate(points: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, severity, key, seq, value) of (metric, key, timestamp, seq, x): where enabled rules fire.

    All rules read the points once.  What fires is as :mod:`spanloom.operators.alerts` says for each kind alone: the
    run's length, the z-score over a day, the speed, 1 for a shape (an oscillation or trend over the last 20), and for a
    composite, at a point where all its rules fire, how many these are.

    Means, speeds, last values and runs of a condition depend on metric and key, so they are made once for all rules.
    """
    spark = points.sparkSession
    by_id = {r["rule_id"]: r for r in rules if r["enabled"]}
    simple = [r for r in by_id.values() if r["type"] != "composite"]
    out = "rule_id string, severity string, key string, seq long, value double"
    if not simple:
        return spark.createDataFrame([], out)
    table = _table(simple)
    slots = max(1, *(len(row[2]) for row in table))
    limits = spark.createDataFrame([row[:3] for row in table], f"metric string, _block int, limits {_LIMITS}")
    rows = points.select("metric", "key", "timestamp", "seq", "x").join(F.broadcast(limits), "metric")
    rows = rows.withColumn("_bad", _violations(slots)).drop("limits")
    by = ("metric", "_block", "key")
    of = lambda kind: [r["config"] for r in simple if r["type"] == kind]
    reach = lambda configs: (F.col("_block") == 0) & F.col("metric").isin([c["metric_name"] for c in configs])
    if odd := of("anomaly"):
        rows = alerts.moments(rows, ANOMALY_HOURS * 3600, by, reach(odd)).drop("n").withColumnsRenamed({"k": "_n", "m": "_m", "s": "_s"})
    windows = sorted({c["window_seconds"] for c in of("rate")})
    for w in windows:
        rows = alerts.starts(rows, w, by, reach([c for c in of("rate") if c["window_seconds"] == w])).drop("_at").withColumnsRenamed({"at0": f"_at{w}", "x0": f"_x{w}"})
    ordered = Window.partitionBy(*by).orderBy("_at", "seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", alerts._micros()).withColumn("_row", F.row_number().over(ordered))
    # A run's length: rows since the last that did not violate.
    fine = (F.max(F.when(F.col("_bad").bitwiseAND(F.lit(1 << j).cast("long")) == 0, F.col("_row"))).over(upto) for j in range(slots))
    more = {"_runs": F.array(*(F.col("_row") - F.coalesce(last, F.lit(0)) for last in fine))}
    if of("pattern"):
        more["_last"] = F.collect_list("x").over(ordered.rowsBetween(-19, 0))
    # Runs of a metric and key are made by one task; rules meet them in many.
    rows = rows.withColumns(more).drop("timestamp", "_bad", "_row").repartition("seq", "metric")

    def value(rule: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        if odd:
            z = F.when((F.col("_n") >= rule["count"]) & (F.col("_s") > 0), (F.col("x") - F.col("_m")) / F.col("_s"))
            out = out.when((rule["kind"] == "anomaly") & (F.abs(z) > rule["amount"]), F.round(z, 6))
        for w in windows:
            speed = F.when(F.col("_at") > F.col(f"_at{w}"), (F.col("x") - F.col(f"_x{w}")) / ((F.col("_at") - F.col(f"_at{w}")) / alerts._MICROS))
            speed = F.when(rule["percent"], F.try_divide(100 * speed, F.abs(F.col(f"_x{w}")))).otherwise(speed)
            out = out.when((rule["kind"] == "rate") & (rule["seconds"] == w) & (F.abs(speed) > rule["amount"]), F.round(speed, 6))
        return out.when((rule["kind"] == "pattern") & _turning("_last", rule["amount"]), F.lit(1.0)) if of("pattern") else out

    def fired(ids: set[str]) -> DataFrame:
        own = [(metric, block, [r for r in waiting if r[2] in ids], [r for r in others if r[1] in ids]) for metric, block, _, waiting, others in table]
        met = rows.join(F.broadcast(spark.createDataFrame(own, f"metric string, _block int, waiting {_WAITING}, others {_OTHERS}")), ["metric", "_block"])
        long_enough = F.filter("waiting", lambda r: F.get("_runs", r["slot"]) >= r["count"])
        runs = F.transform(long_enough, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), F.get("_runs", r["slot"]).cast("double").alias("value")))
        rest = F.transform("others", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), value(r).alias("value")))
        return met.select("key", "seq", F.inline(F.concat(runs, F.filter(rest, lambda r: r["value"].isNotNull())))).select("rule_id", "severity", "key", "seq", "value")

    alone = fired({r["rule_id"] for r in simple})
    composites = [r for r in by_id.values() if r["type"] == "composite"]
    leaves = [(r["rule_id"], r["severity"], leaf, len(own)) for r in composites if (own := _leaves(by_id, r["rule_id"])) for leaf in own]
    if not leaves:
        return alone
    parts = spark.createDataFrame(leaves, "whole string, whole_severity string, rule_id string, parts int")
    met = fired({leaf for _, _, leaf, _ in leaves}).select("rule_id", "key", "seq").join(F.broadcast(parts), "rule_id").groupBy("whole", "whole_severity", "parts", "key", "seq").agg(F.count_distinct("rule_id").alias("n"))
    whole = met.where("n = parts").select(F.col("whole").alias("rule_id"), F.col("whole_severity").alias("severity"), "key", "seq", F.col("n").cast("double").alias("value"))
    return alone.unionByName(whole)


def _leaves(rules: dict[str, dict], start: str) -> set[str]:
    """Simple rules of a composite; none if one of them is not enabled."""
    out, todo, seen = set(), [start], set()
    while todo:
        i = todo.pop()
        if i not in rules:
            return set()
        if i in seen:
            continue
        seen.add(i)
        if rules[i]["type"] == "composite":
            todo += rules[i]["config"]["rule_ids"]
        else:
            out.add(i)
    return out


def _turning(values: str, amount: Column) -> Column:
    """Whether the last values turn, or rise, or fall, in more than a share of ``amount`` of their steps."""
    n = F.size(values)
    step = lambda i: F.element_at(values, i) - F.element_at(values, i - 1)
    turns = F.when(n > 2, F.size(F.filter(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: step(i) * step(i - 1) < 0)) / (n - 2))
    moves = lambda sign: F.size(F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: sign * step(i) > 0)) / (n - 1)
    share = F.greatest(turns, moves(1), moves(-1))
    return F.when(n >= 10, share > amount).otherwise(False)


def export(rules: list[dict]) -> str:
    """JSON that :func:`parse` reads back to the same rules."""
    return json.dumps({"rules": sorted(rules, key=lambda r: r["rule_id"])}, indent=2, sort_keys=True)


class RuleBook:
    """Rules that are kept in a folder, a version for each change; the newest complete one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rules(self) -> list[dict]:
        found = _versions(self.spark, self.folder, "rules")
        return parse("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/rules/version={found[-1]}", wholetext=True).collect()))[0] if found else []

    def _save(self, rules: list[dict]) -> None:
        text = export(rules)
        kept, refused = parse(text)
        if refused:
            raise ValueError("; ".join(f"{i}: {why}" for i, why in refused))
        number = max([0, *_versions(self.spark, self.folder, "rules")]) + 1
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/rules/version={number}")

    def put(self, text: str) -> list[tuple[str, str]]:
        """Add the rules of a JSON text, or replace those of the same ids; what was refused."""
        held = {r["rule_id"]: r for r in self.rules()}
        listed = json.loads(text).get("rules", [])
        named = {r["rule_id"] for r in listed if isinstance(r, dict) and isinstance(r.get("rule_id"), str)}
        new, refused = parse(json.dumps({"rules": [*listed, *(r for i, r in held.items() if i not in named)]}))
        self._save(new)
        return refused

    def remove(self, rule_id: str) -> bool:
        held = self.rules()
        if all(r["rule_id"] != rule_id for r in held):
            return False
        self._save([r for r in held if r["rule_id"] != rule_id])
        return True

    def enable(self, rule_id: str, enabled: bool) -> bool:
        held = self.rules()
        if all(r["rule_id"] != rule_id for r in held):
            return False
        self._save([r | {"enabled": enabled} if r["rule_id"] == rule_id else r for r in held])
        return True


#: Settings of a rule evaluator and their types.
_EVALUATOR = {"condition": str, "patterns": list, "required": list, "forbidden": list, "min_length": int, "max_length": int}


def evaluators(text: str, tag: str | None = None) -> tuple[list[dict], list[tuple[str, str]]]:
    """(definitions, refused) of a JSON list of rule evaluators, those with ``tag`` only where it is given."""
    good, refused = {}, []
    for n, raw in enumerate(json.loads(text)):
        name = raw.get("name") if isinstance(raw, dict) else None
        config = raw.get("config") if isinstance(raw, dict) else None
        why = None
        if not isinstance(name, str) or not name:
            why = "no name"
        elif name in good:
            why = "repeated name"
        elif raw.get("type", "rule") != "rule":
            why = f"type that does not run here: {raw['type']}"
        elif not isinstance(config, dict) or not config:
            why = "no rules"
        elif extra := config.keys() - _EVALUATOR.keys():
            why = f"unknown settings: {', '.join(sorted(extra))}"
        elif wrong := [k for k, v in config.items() if not isinstance(v, _EVALUATOR[k]) or isinstance(v, bool)]:
            why = f"wrong type: {', '.join(sorted(wrong))}"
        else:
            try:
                evals.condition(config["condition"]) if "condition" in config else None
            except ValueError as error:
                why = str(error)
        if why:
            refused.append((str(name or f"#{n}"), why))
        else:
            good[name] = {"version": "1.0.0", "tags": [], "enabled": True} | raw
    return [d for d in good.values() if d["enabled"] and (tag is None or tag in d["tags"])], refused


def run_evaluators(rows: DataFrame, definitions: list[dict], key: str = "id") -> DataFrame:
    """(key, evaluator, verdict, score, failures) of (key, input, output): all evaluators in one pass."""
    each = [F.struct(F.lit(d["name"]).alias("evaluator"), evals.rule_failures(d["config"]).alias("failures"), F.lit(_parts(d["config"])).alias("parts")) for d in definitions]
    out = rows.select(key, F.inline(F.array(*each)))
    share = F.round(1 - F.size("failures") / F.col("parts"), 6)
    return out.select(key, "evaluator", F.when(F.size("failures") == 0, "pass").otherwise("fail").alias("verdict"), share.alias("score"), F.array_join("failures", ",").alias("failures"))


def _parts(config: dict) -> int:
    return sum(len(v) if isinstance(v, list) else 1 for v in config.values())
