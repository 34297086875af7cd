"""Guarded ad-hoc SQL: Spark parses it, the parsed plan is checked, Spark runs it.

Every relation of the plan, in joins and subqueries too, must be one of the logical tables or a name
that the query itself defines where it is used; every step and every part of an expression must be of a listed
kind, so table functions, files, commands and functions named by expressions do not pass; every function
must be on the list.  The analysed plan is checked for foreign code once more, the optimised one for joins of all
pairs.  Functions of the column store that the dashboards were written for are rewritten to Spark's.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# The logical tables, the most rows, and the functions with their names.
TABLES = {"traces", "spans", "metrics", "logs", "models", "services", "cost_summary", "token_usage"}
MOST_ROWS = 10_000

#: Functions of the column store with another name here.
RENAMED = {
    "uniq": "approx_count_distinct",
    "stddev": "stddev_pop",
    "variance": "var_pop",
    "groupArray": "collect_list",
    "groupUniqArray": "collect_set",
    "toDate": "to_date",
    "toDateTime": "to_timestamp",
    "any": "any_value",
    "anyLast": "last",
    "argMax": "max_by",
    "argMin": "min_by",
    "countIf": "count_if",
    "toHour": "hour",
    "today": "current_date",
    "length": "octet_length",
}
#: Functions of the column store with another form here, by number of arguments.
REFORMED = {
    ("uniqExact", 1): "count(DISTINCT {0})",
    ("toStartOfMinute", 1): "date_trunc('minute', {0})",
    ("toStartOfHour", 1): "date_trunc('hour', {0})",
    ("toStartOfDay", 1): "date_trunc('day', {0})",
    ("toString", 1): "cast({0} AS string)",
    ("toUInt8", 1): "cast({0} AS smallint)",
    ("toInt64", 1): "cast({0} AS bigint)",
    ("toFloat64", 1): "cast({0} AS double)",
    ("toYYYYMM", 1): "cast(date_format({0}, 'yyyyMM') AS int)",
    ("toDayOfWeek", 1): "(weekday({0}) + 1)",
    ("avgIf", 2): "avg(CASE WHEN {1} THEN {0} END)",
    ("sumIf", 2): "sum(CASE WHEN {1} THEN {0} END)",
}
#: The same for functions with parameters in brackets of their own: ``{0}`` is the argument, ``{p}`` the parameters.
PARAMETRIC = {"quantile": "percentile({0}, {p})", "quantiles": "percentile({0}, array({p}))", "topK": "approx_top_k({0}, {p})"}
FUNCTIONS = {
    "count", "sum", "avg", "min", "max", "median", "lower", "upper", "octet_length", "char_length", "substring", "trim", "coalesce", "nullif", "if",
    "approx_count_distinct", "percentile", "stddev_pop", "var_pop", "collect_list", "collect_set", "date_trunc", "to_date", "to_timestamp",
    "any_value", "last", "max_by", "min_by", "count_if", "hour", "round", "abs", "when", "weekday", "date_format", "array", "approx_top_k", "current_date",
    "between",  # how Spark parses the operator
}


class QueryRefused(ValueError):
    """The query is not one that may run."""


_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.""", re.DOTALL)


def translate(sql: str) -> str:
    """The text with function calls in Spark's spelling, nested ones too; literals, quoted names and comments stay."""
    return "".join(_calls(_TOKEN.findall(sql)))


def _bracket(tokens: list[str], at: int) -> int:
    """Where the bracket that opens at ``at`` closes; the end if it does not."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        if not depth:
            return i
    return len(tokens)


def _arguments(tokens: list[str]) -> list[str]:
    out, depth = [[]], 0
    for token in tokens:
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == "," and not depth:
            out.append([])
        else:
            out[-1].append(token)
    return ["".join(_calls(part)).strip() for part in out]


def _calls(tokens: list[str]) -> Iterator[str]:
    i = 0
    while i < len(tokens):
        name, at = tokens[i], i + 1
        while at < len(tokens) and tokens[at].isspace():
            at += 1
        if not re.fullmatch(r"\w+", name) or at == len(tokens) or tokens[at] != "(":
            yield name
            i += 1
            continue
        end = _bracket(tokens, at)
        inside = _arguments(tokens[at + 1 : end])
        if name in PARAMETRIC and end + 1 < len(tokens) and tokens[end + 1] == "(":
            parameters, at = ", ".join(inside), end + 1
            end = _bracket(tokens, at)
            yield PARAMETRIC[name].format(*_arguments(tokens[at + 1 : end]), p=parameters)
        elif name == "multiIf" and len(inside) % 2 and len(inside) > 1:
            cases = " ".join(f"WHEN {a} THEN {b}" for a, b in zip(inside[::2], inside[1::2]))
            yield f"CASE {cases} ELSE {inside[-1]} END"
        elif (name, len(inside)) in REFORMED:
            yield REFORMED[name, len(inside)].format(*inside)
        else:
            yield RENAMED.get(name, name) + "("
            yield from _calls(tokens[at + 1 : end])
            yield ")" * (end < len(tokens))
        i = end + 1


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


#: Steps of a parsed query; all other kinds are refused.
_STEPS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "OneRowRelation",
}
_SUBQUERIES = {"ScalarSubquery", "Exists", "InSubquery", "ListQuery"}
#: Parts of expressions; all other kinds are refused, such as functions that are named by an expression.
_EXPRESSIONS = _SUBQUERIES | {
    "UnresolvedFunction", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedExtractValue", "UnresolvedOrdinal", "UnresolvedWindowExpression",
    "Alias", "MultiAlias", "Literal", "Cast", "NamedParameter", "PosParameter", "SortOrder", "CaseWhen", "And", "Or", "Not", "IsNull", "IsNotNull",
    "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "Between", "Like", "ILike", "RLike",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "Concat",
    "WindowExpression", "WindowSpecDefinition", "WindowSpecReference", "SpecifiedWindowFrame", "UnspecifiedFrame$", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$",
    "RowFrame$", "RangeFrame$", "Cube", "Rollup", "GroupingSets", "TimestampAddInterval", "CurrentDate", "CurrentTimestamp",
}
#: Code of others that an analysed query must not hold, under whatever name it came.
_FOREIGN = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "HiveSimpleUDF", "HiveGenericUDF", "Invoke"}


class _Reader:
    """Walks a parsed plan; names of common table expressions hold where SQL says they hold."""

    def __init__(self, tables: set[str]):
        self.tables = tables
        self.unknown: set[str] = set()
        self.functions: set[str] = set()
        self.steps: set[str] = set()

    def plan(self, node, named: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in _STEPS:
            self.steps.add(kind)
        if kind == "UnresolvedRelation":
            parts = [str(p) for p in _each(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0].lower() not in self.tables | named:
                self.unknown.add(".".join(parts))
        if kind == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                self.plan(pair._2(), named)  # sees those before it, and not itself
                named |= {str(pair._1()).lower()}
        for child in _each(node.children()):
            self.plan(child, named)
        for expression in _each(node.expressions()):
            self.expression(expression, named)

    def expression(self, node, named: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in _EXPRESSIONS:
            self.steps.add(kind)
        if kind == "UnresolvedFunction":
            self.functions.add(".".join(_each(node.nameParts())))
        if kind in _SUBQUERIES:
            self.plan((node.query() if kind == "InSubquery" else node).plan(), named)
        for child in _each(node.children()):
            self.expression(child, named)


def check(spark: SparkSession, sql: str, tables: set[str] = TABLES) -> None:
    """Raise :class:`QueryRefused` unless the query reads these tables with listed functions only."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # the parser's message is what the caller needs
        raise QueryRefused(str(error).splitlines()[0]) from None
    found = _Reader(set(tables))
    found.plan(plan, frozenset())
    if not re.match(r"\s*(select|with)\b", sql, re.IGNORECASE) or found.steps:
        raise QueryRefused(f"only queries over tables: {', '.join(sorted(found.steps))}")
    if found.unknown:
        raise QueryRefused(f"unknown tables: {', '.join(sorted(found.unknown))}")
    if extra := {f for f in found.functions if f.lower() not in FUNCTIONS}:
        raise QueryRefused(f"functions that are not allowed: {', '.join(sorted(extra))}")


def _plans(plan) -> Iterator:
    """The plan's steps, those of its subqueries too."""
    yield plan
    for child in _each(plan.children()):
        yield from _plans(child)
    for inner in _each(plan.subqueries()):
        yield from _plans(inner)


def _within(expression) -> Iterator:
    yield expression
    for child in _each(expression.children()):
        yield from _within(child)


def check_analysed(frame: DataFrame) -> None:
    """Raise :class:`QueryRefused` if foreign code is called, or all pairs of two tables are asked for."""
    execution = frame._jdf.queryExecution()
    for step in _plans(execution.analyzed()):
        for expression in _each(step.expressions()):
            if extra := {_kind(e) for e in _within(expression)} & _FOREIGN:
                raise QueryRefused(f"functions that are not allowed: {', '.join(sorted(extra))}")
    for step in _plans(execution.optimizedPlan()):
        if _kind(step) == "Join" and step.condition().isEmpty():
            most = [side.maxRows() for side in (step.left(), step.right())]
            if not any(m.isDefined() and m.get() <= 1 for m in most):
                raise QueryRefused("a join without a condition")


def run(spark: SparkSession, views: dict[str, DataFrame], sql: str, **parameters) -> DataFrame:
    """The query's rows, at most ``MOST_ROWS``; values are passed as ``:name`` parameters.

    The caller's own views stay as they are: tables have names of their own while the query is analysed.
    """
    text = translate(sql).strip().rstrip("; \n\t")
    if extra := set(views) - TABLES:
        raise QueryRefused(f"no logical tables: {', '.join(sorted(extra))}")
    check(spark, text, set(views))
    mark = f"guarded_{uuid.uuid4().hex}"
    try:
        for name, view in views.items():
            view.createOrReplaceTempView(f"{mark}_{name}")
        tables = ", ".join(f"{name} AS (SELECT * FROM {mark}_{name})" for name in views)
        frame = spark.sql(f"WITH {tables} SELECT * FROM (\n{text}\n)", args=parameters or None)
        check_analysed(frame)
    finally:
        for name in views:
            spark.catalog.dropTempView(f"{mark}_{name}")
    return frame.limit(MOST_ROWS)
