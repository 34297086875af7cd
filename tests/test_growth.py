"""Steps whose memory, shuffles or time grew faster than their input."""

import json
import random
import re
from functools import reduce

from pyspark.sql import functions as F

from spanloom.operators import alerts, drift, rca, scrubbing, vectors
from spanloom.sources import otlp


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_only_edges_are_collected_by_feature(spark):
    rows = spark.range(2000).selectExpr("'f' as feature", "cast(id * 7919 % 2000 as double) as v")
    made = drift.psi_reference(rows)
    assert any(("Join" in line or "Filter" in line) and "size(filter(" in line for line in plan(made).splitlines())
    one = made.collect()[0]
    assert one.edges == [float(i * 1999 // 10) for i in range(1, 10)] and sum(one.expected) == 2000


def test_edits_are_measured_without_comparing_whole_texts(spark):
    texts = ["a b  c", "one two three", "é\nü  straße 漢字 x\t", " lead and trail ", "solo", "a\nb\nc\nd\ne\nf", "  \n", "", "a a a a aa", None, "x [REPLACED] y", "one\n two\r\nthree \n\n\nfour five six"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cut = rca.token_influence(frame.where("length(text) > 0"))
    assert "levenshtein" not in plan(cut)
    for r in cut.collect():
        words = texts[r.id].split(" ")
        without = " ".join(words[: r.position] + words[r.position + 1 :])
        assert r.token == words[r.position] and r.influence == round(levenshtein(texts[r.id], without) / len(texts[r.id]), 8)
    made = rca.counterfactuals(frame, 5, 0.0, 1.0)
    got = made.collect()
    assert "levenshtein(text" in plan(made) and "levenshtein(text#" not in plan(made).split("Generate")[0]
    for r in got:
        assert r.similarity == round(1 - levenshtein(texts[r.id], r.edited) / max(len(texts[r.id]), len(r.edited)), 8), r
    assert len({r.id for r in got}) == 9 and {r.edit for r in got} == {"delete", "replace", "insert"}


def test_scores_are_held_for_a_bounded_number_of_pairs(spark, monkeypatch):
    rows = [(i, [float((i * 7 + k * k) % 11 - 5) + i / 1000 for k in range(4)]) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = frame.where("vec_id % 4 = 0")
    want = sorted(vectors.top_k(frame, asked, 3).collect()), sorted(vectors.best_reference(frame, asked).collect())
    monkeypatch.setattr(vectors, "PAIRS", 100)

    def held(metric, queries, own, scores=vectors._scores):
        if len(queries) * len(own) > 100:
            raise ValueError("too many pairs at once")
        return scores(metric, queries, own)

    monkeypatch.setattr(vectors, "_scores", held)
    assert (sorted(vectors.top_k(frame, asked, 3).collect()), sorted(vectors.best_reference(frame, asked).collect())) == want


def test_messages_are_checked_and_parsed_once(spark):
    deep = lambda n, open_="[", close="]": '{"a": ' + open_ * n + close * n + "}"
    rows = [(deep(n), n > 31) for n in (0, 1, 3, 4, 27, 28, 30, 31, 32, 33, 40)] + [('{"a": [[], [[]], {"b": [{}]}, "]]"]}', False), ("[" * 33 + "{}" + "]" * 33, True), ("[}", True), ("[{]}", True)]
    rows = [(t if n != '{"a": }' else "{}", d) for (t, d), n in zip(rows, [r[0] for r in rows], strict=True)]
    got = spark.createDataFrame(rows, "text string, want boolean").select("text", "want", otlp.too_deep(F.col("text")).alias("deep")).collect()
    assert all(r.want == r.deep for r in got), [r for r in got if r.want != r.deep]
    messages = spark.createDataFrame([('{"resourceSpans": []}',), (None,), ("{no",)], "value string")
    made = plan(otlp.flatten(messages))
    assert made.count("from_json") == 1 and made.count("get_json_object") == 1 and otlp.refused(messages).count() == 2


def test_rows_are_sent_to_a_bounded_number_of_blocks(spark, monkeypatch):
    rows = [("k", "ref" if i % 2 else "cur", i, [float((i * 7 + k * k) % 13) for k in range(3)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "key string, side string, id long, embedding array<float>")
    want = drift.mmd(frame, 20, block=512).collect()[0]
    monkeypatch.setattr(drift, "MOST_BLOCKS", 3)
    got = drift.mmd(frame, 20, block=10).collect()[0]
    assert abs(got.mmd2 - want.mmd2) < 1e-9 and got.p_value == want.p_value


def test_last_values_meet_across_ranges_of_a_key(spark):
    mark = random.Random(7)
    sizes = {"long": 700, "other": 260, "short": 9, "one": 1, "ten": 10}
    value = lambda i: (mark.choice([1, 2, 2, 3, 90, -90]), i, -i, 50 * (i % 60 > 30))[i // 60 % 4]
    rows = [(k, i // 3, i, None if mark.random() < 0.05 else float(value(i))) for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(mark.sample(rows, len(rows)), "key string, timestamp int, seq long, x double")

    def shape(v):
        n, last = len(v), v[-1]
        mean = lambda a: sum(a) / len(a)
        m = mean(v[:-1])
        sd = mean([(x - m) * (x - m) for x in v[:-1]]) ** 0.5
        ups = sum(b > a for a, b in zip(v, v[1:]))
        if sd > 0 and (last > m + 3 * sd or last < m - 3 * sd):
            return "spike" if last > m else "dip"
        if sd > 0 and abs(mean(v[n // 2 :]) - mean(v[: n // 2])) > 2 * sd:
            return "step"
        return "rise" if ups >= 0.8 * (n - 1) else "fall" if ups <= 0.2 * (n - 1) else None

    def turns(v):
        d = [b - a for a, b in zip(v, v[1:])]
        return round(sum(a * b < 0 for a, b in zip(d, d[1:])) / (len(v) - 2), 8)

    shapes, turning = set(), set()
    for key, n in sizes.items():
        x = [r[3] for r in rows if r[0] == key]
        for i in range(n):
            v = [a for a in x[max(0, i - 19) : i + 1] if a is not None]
            if len(v) >= 10:
                shapes |= {(key, i, kind) for kind in [shape(v)] if kind}
                turning |= {(key, i, share) for share in [turns(v)] if share > 0.6}
    for n in (1, 7, 60):  # ranges shorter than a frame among them
        old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
        try:
            for c, value in zip(old, (str(n), "false", "13" if n == 7 else "10000")):
                spark.conf.set(c, value)
            made = alerts.patterns(frame)
            assert "Window" not in plan(made)  # a window of a key's rows is one task
            got, turned = made.collect(), alerts.oscillation(frame, sensitivity=0.6).collect()
        finally:
            for c, value in old.items():
                spark.conf.set(c, value)
        assert len(got) == len(shapes) and {tuple(r) for r in got} == shapes, n
        assert len(turned) == len(turning) and {tuple(r) for r in turned} == turning, n
    assert {kind for _, _, kind in shapes} == {"spike", "dip", "step", "rise", "fall"} and turning


def test_patterns_are_tried_only_where_a_match_can_be(spark):
    mark = random.Random(11)
    heads = ["", "x", "-", "(", "http://u:p", "k\u0131", "=", "_"]
    parts = ["me@x.org", "555-123-4567", "5551234567", "123 45 6789", "4111111111111111", "378282246310005", "sk-" + "a1" * 13, "API_KEY-" + "b" * 20, "\u017fecret" + "c" * 20, "to\u212aen" + "d" * 20, "bearer  a.b.c", "BEARER\nq",
             "ASIA" + "Z9" * 8, "a/+=" * 10, "x" * 40, "10.0.0.1", "1.2.3.444", "pa\u017f\u017fword = 1", "Passwd:'y'", "pwd=1", "\u017fecret: 2", "CREDENT\u0130AL=3", "cred\u0131ntial=4", "credent\u0131al 5", "secret:6", "https://u:p@h", "\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669", "\u0661.\u0662.\u0663.\u0664", "plain", "2024", "a@b", "A1"]
    texts = ["", None, " ", *parts, *(mark.choice(heads) + p for p in parts for _ in range(4)), *("".join(mark.choice([p + s for s in (" ", "", "\n", "\u00a0", "=", "é")]) for p in mark.choices(parts, k=mark.randrange(1, 7))) for _ in range(300))]
    own = [("email", "nothing", "never"), ("mine", "pl(?:ai)n", "[P]"), ("email", "A1", "[A]")]  # names that mean something else
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("j", F.when(F.col("t").isNotNull(), F.to_json(F.struct("t"))))
    for patterns in (scrubbing.PATTERNS, scrubbing.CLIENT_PATTERNS, own):
        plain = reduce(lambda t, p: F.regexp_replace(t, p[1], p[2]), patterns, F.col("t"))
        made = scrubbing.scrub(frame.withColumn("want", plain), ["j"], ["want"], patterns)
        changed = 0
        for r in made.collect():
            text = texts[r.id]
            assert r.t == r.want, (text, r.t)
            if text is not None:
                want = reduce(lambda t, p: re.sub(p[1], lambda _: p[2], t), patterns, text)
                assert json.loads(r.j)["t"] == want, (text, r.j)
                changed += want != text
        assert changed > 20
    # Each text is looked at before its patterns are, and by one look for neighbours that need the same.
    made = plan(frame.select(scrubbing.scrub_text(F.col("t")).alias("t")))
    assert made.count("RLIKE(") == 9 and made.count("regexp_replace(") == 11
