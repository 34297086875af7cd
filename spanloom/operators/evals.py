"""Text evaluators: safety, retrieval scores, rules and judges, all as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of personal data and their patterns, replaced in this order.
PII = {
    "email": r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b(\+1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "api_key": r"(?i)\b(sk-|pk_|api[_-]?key[=:]\s*)[a-zA-Z0-9]{20,}\b",
}

# Word lists by category.
TOXIC = {
    "violence": ["kill", "murder", "attack", "bomb", "weapon", "terrorist", "assault", "shoot", "stab"],
    "self_harm": ["suicide", "self-harm", "cut myself", "end my life"],
    "dangerous": ["how to make a bomb", "synthesize drugs", "hack into", "bypass security", "exploit vulnerability"],
}

LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
# Kind of injection, risk, pattern.
INJECTION = [
    ("direct", HIGH, r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|text)"),
    ("direct", HIGH, r"disregard\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?)"),
    ("direct", HIGH, r"forget\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?)"),
    ("direct", MEDIUM, r"new\s+instructions?\s*:"),
    ("direct", HIGH, r"override\s+(system|previous)\s+(prompt|instructions?)"),
    ("jailbreak", CRITICAL, r"DAN\s+mode|do\s+anything\s+now"),
    ("jailbreak", CRITICAL, r"developer\s+mode|god\s+mode"),
    ("jailbreak", CRITICAL, r"jailbreak|jailbroken"),
    ("jailbreak", HIGH, r"bypass\s+(safety|content|filter|restriction)"),
    ("jailbreak", HIGH, r"pretend\s+you\s+(are|have)\s+no\s+(rules|restrictions|limits)"),
    ("jailbreak", HIGH, r"act\s+as\s+if\s+you\s+(have\s+no|don't\s+have)\s+(rules|restrictions)"),
    ("role_play", MEDIUM, r"pretend\s+(to\s+be|you\s+are)\s+a\s+(different|new|other)\s+AI"),
    ("role_play", LOW, r"you\s+are\s+now\s+(a|an)\s+"),
    ("role_play", LOW, r"roleplay\s+as\s+"),
    ("role_play", LOW, r"simulate\s+being\s+"),
    ("context_leak", MEDIUM, r"what\s+(is|are)\s+(your|the)\s+(system\s+)?(prompt|instructions?)"),
    ("context_leak", MEDIUM, r"reveal\s+(your|the)\s+(system\s+)?(prompt|instructions?)"),
    ("context_leak", MEDIUM, r"show\s+(me\s+)?(your|the)\s+(hidden|secret|original)\s+(prompt|instructions?)"),
    ("context_leak", MEDIUM, r"print\s+(your|the)\s+(system\s+)?(prompt|instructions?)"),
    ("context_leak", MEDIUM, r"repeat\s+(your|the)\s+(initial|original)\s+(prompt|instructions?)"),
    ("recursive", HIGH, r"\[\[SYSTEM\]\]|\[\[USER\]\]|\[\[ASSISTANT\]\]"),
    ("recursive", HIGH, r"<\|im_start\|>|<\|im_end\|>"),
    ("recursive", MEDIUM, r"###\s*(System|User|Assistant)\s*:"),
    ("recursive", MEDIUM, r"\[INST\]|\[/INST\]"),
    ("delimiter", LOW, r"\n{5,}|\\n{5,}"),
    ("delimiter", LOW, r"-{10,}|={10,}|\*{10,}"),
    ("indirect", MEDIUM, r"when\s+you\s+(read|see|process)\s+this"),
    ("indirect", MEDIUM, r"if\s+you\s+are\s+(an?\s+)?(AI|LLM|language\s+model|assistant)"),
    ("indirect", MEDIUM, r"attention\s+(AI|assistant|model)"),
]


def pii_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{name}") for name, p in PII.items()]


def _places(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches of a pattern that matches no empty text, by what lies between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))
    piece = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("skip"), m.alias("match")))

    def step(done: Column, p: Column) -> Column:
        a = done["at"] + p["skip"]
        b = a + F.length(p["match"])
        return F.struct(b.alias("at"), F.concat(done["out"], F.array(F.struct(a.alias("start"), b.alias("end"), p["match"].alias("match")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(piece, start, step, lambda d: d["out"]))


def pii_spans(text: Column) -> Column:
    """array of (kind, start, end, match) by kind as listed, then by place; code points from 0, the end exclusive."""
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))
    return F.flatten(F.array_compact(F.array(*(F.transform(_places(text, p), named(kind)) for kind, p in PII.items()))))


def injection_spans(text: Column) -> Column:
    """array of (kind, risk, start, end): the first place of every injection pattern that matches, as listed."""
    def first(kind: str, risk: int, p: str) -> Column:
        match = F.regexp_extract(text, f"(?i){p}", 0)
        start = F.length(F.element_at(F.split(text, f"(?i){p}", 2), 1))
        return F.when(match != "", F.struct(F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), start.alias("start"), (start + F.length(match)).alias("end")))

    return F.array_compact(F.array(*(first(*i) for i in INJECTION)))


def pii_scrub(text: Column) -> Column:
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[{kv[0].upper()}_REDACTED]"), PII.items(), text)


def toxicity(text: Column) -> Column:
    """score: the largest over categories of 0.3 for each listed phrase in the text, at most 1."""
    low = F.lower(text)
    found = lambda words: reduce(Column.__add__, (F.contains(low, F.lit(w)).cast("int") for w in words))
    scores = {c: F.least(F.round(0.3 * found(words), 6), F.lit(1.0)) for c, words in TOXIC.items()}
    top = F.greatest(*scores.values())
    return F.struct(*(s.alias(c) for c, s in scores.items()), top.alias("score"), (top >= 0.5).alias("toxic"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` made once however often it stands there."""
    return F.transform(F.array(value), then)[0]


def _hits(text: Column) -> Column:
    every = F.array(*(F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(risk).alias("risk"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"))) for i, (kind, risk, p) in enumerate(INJECTION)))
    return F.filter(every, lambda h: h.isNotNull())


def _said(hits: Column) -> Column:
    best, n = F.array_max(hits), F.size(hits)
    confidence = F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.4), 0.1 * n) + 0.1 * best["risk"])
    return F.struct(
        n.cast("long").alias("matches"),
        F.coalesce(best["risk"], F.lit(0)).cast("long").alias("risk"),
        F.coalesce(best["kind"], F.lit("none")).alias("kind"),
        F.round(F.when(n > 0, confidence).otherwise(0.0), 6).alias("confidence"),
    )


def injection(text: Column) -> Column:
    """Number of patterns that match, the highest risk, its first kind, and a confidence."""
    return _said(_hits(text))


#: Name and pattern of what looks like delimiters of another prompt.
DELIMITERS = [
    ("bracket_delimiter", r"\[\[|]]|\{\{|\}\}|<<<|>>>"),
    ("horizontal_delimiter", r"---+|===+|\*\*\*+"),
    ("code_block", r"```.*```"),
    ("special_delimiter", r"<\|.*\|>"),
    ("whitespace_delimiter", r"\\n\\n\\n|\\r\\n\\r\\n"),
]


def delimiters(text: Column) -> Column:
    """Names of the delimiters in a text; any of them makes the risk at least medium."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in DELIMITERS)))


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, words parted by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def listed(text: Column, blocked: list[str], allowed: list[str]) -> Column:
    """allowed for a text that is on the one list as a whole, blocked for one that holds a phrase of the other."""
    low = normalised(text)
    hit = reduce(Column.__or__, (F.contains(low, F.lit(b)) for b in blocked), F.lit(False))
    return F.when(low.isin(*allowed), "allowed").when(hit, "blocked").otherwise("neither")


def fan_in(similarity: DataFrame, rules: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, score) of a similarity and (id, score, passed) of rules: the mean score, and whether all passed."""
    both = similarity.select("id", "score", (F.col("score") >= least).alias("passed")).unionByName(rules.select("id", "score", "passed"))
    return both.groupBy("id").agg(F.round(F.avg("score"), 8).alias("score"), F.bool_and("passed").alias("passed"), F.count("*").alias("n"))


def encoded_payloads(text: Column) -> Column:
    """Printable texts of over ten characters behind Base64 (20 or more) or hexadecimal (40 or more) runs."""
    base64 = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    hexed = F.regexp_extract_all(text, F.lit(r"(?:[0-9a-fA-F]{2}){20,}"), F.lit(0))
    plain = lambda run, how: F.try_to_binary(run, F.lit(how)).try_cast("string")
    decoded = F.concat(F.transform(base64, lambda x: plain(x, "base64")), F.transform(hexed, lambda x: plain(x, "hex")))
    return F.filter(decoded, lambda t: t.isNotNull() & (F.length(t) > 10) & t.rlike(r"^[\x20-\x7E\n\r\t]+$"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` made once however often it stands there."""
    return F.transform(F.array(value), then)[0]


def encoded_injection(text: Column) -> Column:
    """Payloads behind encoded runs, those behind runs inside them too, and what :func:`injection` says of them."""
    inside = lambda outer: F.concat(outer, F.flatten(F.transform(outer, encoded_payloads)))
    whole = lambda every, found: F.struct(F.size(every).cast("long").alias("payloads"), *(found[c].alias(c) for c in ("matches", "risk", "kind", "confidence")))
    scan = lambda every: _once(_once(F.array_join(every, "\n"), _hits), lambda hits: whole(every, _said(hits)))
    return _once(encoded_payloads(text), lambda outer: _once(inside(outer), scan))


def keywords(text: Column) -> Column:
    """Distinct lower-case runs of at least three ASCII letters and digits."""
    runs = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(runs, lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def claims(text: Column) -> Column:
    """Sentences of over ten bytes; the whole text where there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]"), F.lit(0)), lambda s: F.trim(s))
    found = F.filter(found, lambda s: F.octet_length(s) > 10)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def rag_scores(rows: DataFrame) -> DataFrame:
    """Scores of (id, question, answer, contexts): relevance, faithfulness, groundedness and overall."""
    out = rows.withColumns({"q": keywords(F.col("question")), "a": keywords(F.col("answer")), "c": F.transform("contexts", keywords)})
    weights = F.aggregate(F.sequence(F.lit(1), F.size("c")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    weighted = F.aggregate(F.transform("c", lambda c, i: jaccard(F.col("q"), c) / (i + 1)), F.lit(0.0), lambda s, x: s + x)
    said = F.transform(claims(F.col("answer")), keywords)
    supported = F.filter(said, lambda k: F.exists("c", lambda c: jaccard(k, c) > 0.4))
    every = F.array_distinct(F.flatten("c"))
    grounded = F.filter(said, lambda k: jaccard(k, every) > 0.3)
    out = out.withColumns(
        {
            "relevance": F.coalesce(F.try_divide(weighted, weights), F.lit(0.0)),
            "faithfulness": F.size(supported) / F.size(said),
            "answer_relevance": jaccard(F.col("q"), F.col("a")),
            "groundedness": F.size(grounded) / F.size(said),
        }
    )
    overall = 0.2 * F.col("relevance") + 0.4 * F.col("faithfulness") + 0.3 * F.col("answer_relevance") + 0.1 * F.col("groundedness")
    names = ("relevance", "faithfulness", "answer_relevance", "groundedness")
    verdict = F.when(overall >= 0.7, "pass").when(overall >= 0.5, "warn").otherwise("fail")
    return out.select("id", *(F.round(n, 6).alias(n) for n in names), F.round(overall, 6).alias("overall"), (F.col("faithfulness") < 0.5).alias("hallucination"), verdict.alias("verdict"))


_TOKEN = re.compile(r"\s*(len\((?:input|output)\)|input_len|output_len|&&|\|\||[<>]=?|[=!]=|\d+(?:\.\d+)?|[()])")


def condition(text: str) -> Column:
    """``len(output) > 10 && output_len < 2000`` over columns input and output, with usual precedence."""
    out, shape, at = [], "", 0
    while at < len(text.rstrip()):
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"unexpected text at {at}: {text}")
        token = match[1]
        named = re.fullmatch(r"len\((input|output)\)|(input|output)_len", token)
        shape += "v" if named or token[0].isdigit() else token if token in "()" else "b" if token in ("&&", "||") else "c"
        out.append(f"char_length({named[1] or named[2]})" if named else {"&&": "AND", "||": "OR", "==": "="}.get(token, token))
        at = match.end()
    while shape != (less := re.sub(r"vcv|\(e\)|ebe", "e", shape.replace("(v)", "v"))):
        shape = less
    if shape != "e":  # values that are compared, and what joins them
        raise ValueError(f"no condition: {text}")
    return F.expr(" ".join(out))


def rule_failures(rule: dict) -> Column:
    """Names of the parts of a rule that the row's input and output fail; empty if it passes."""
    output = F.col("output")
    low = F.lower(output)
    checks = []
    if "condition" in rule:
        checks.append(("condition", condition(rule["condition"])))
    checks += [(f"pattern:{p}", output.rlike(p)) for p in rule.get("patterns", ())]
    checks += [(f"required:{w}", F.contains(low, F.lit(w))) for w in rule.get("required", ())]
    checks += [(f"forbidden:{w}", ~F.contains(low, F.lit(w))) for w in rule.get("forbidden", ())]
    if "min_length" in rule:
        checks.append(("min_length", F.char_length(output) >= rule["min_length"]))
    if "max_length" in rule:
        checks.append(("max_length", F.char_length(output) <= rule["max_length"]))
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks)))


def judge(reply: Column) -> Column:
    """Verdict and score of a judge's reply: JSON, or plain text that says pass or fail."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "verdict string, score double")
    low = F.lower(reply)
    plain = F.when(F.contains(low, F.lit("fail")), "fail").when(F.contains(low, F.lit("pass")), "pass").otherwise("unknown")
    verdict = F.coalesce(F.lower(parsed["verdict"]), plain)
    score = F.coalesce(parsed["score"], F.when(verdict == "pass", 0.8).when(verdict == "fail", 0.2).otherwise(0.5))
    return F.struct(verdict.alias("verdict"), score.alias("score"))


def judge_prompt(template: str) -> Column:
    """A judge's prompt for rows of input, output, contexts and expected; ``{input}`` and so on stand for them.

    Values go in at once, so that a value that looks like a name is not replaced again.
    """
    listed = F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("- "), c, F.lit("\n"))), "")
    values = {
        "{input}": F.coalesce("input", F.lit("")),
        "{output}": F.coalesce("output", F.lit("")),
        "{context}": F.when(F.coalesce(F.size("contexts"), F.lit(0)) > 0, listed).otherwise("(No context provided)"),
        "{expected}": F.coalesce("expected", F.lit("(Not provided)")),
    }
    parts = re.split("(" + "|".join(map(re.escape, values)) + ")", template)
    return F.concat(*(values.get(part, F.lit(part)) for part in parts))


def judge_pair(reply: Column) -> Column:
    """(verdict, score) of a judge that compared two outputs: pass if A won, fail if B did, unsure for a tie.

    A reply that is no JSON is an error without a score; one that names no winner is a tie.
    """
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "winner string, score_a double")
    json = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$").isNotNull()
    verdict = F.when(~json | reply.isNull(), "error").when(parsed["winner"] == "A", "pass").when(parsed["winner"] == "B", "fail").otherwise("unsure")
    return F.struct(verdict.alias("verdict"), F.when(verdict != "error", F.coalesce(parsed["score_a"], F.lit(0.5))).alias("score"))


def health(drift: Column, risk: Column, score: Column) -> Column:
    """1 - 0.3 drift - 0.4 risk - 0.3 (1 - score), held between 0 and 1; what is missing costs nothing."""
    lost = 0.3 * F.coalesce(drift, F.lit(0.0)) + 0.4 * F.coalesce(risk, F.lit(0.0)) + 0.3 * (1 - F.coalesce(score, F.lit(1.0)))
    return F.least(F.greatest(1 - lost, F.lit(0.0)), F.lit(1.0))
