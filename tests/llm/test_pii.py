import hashlib
import random
import re

from spanloom.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    n = [sum(x[0] == k for x in out) for k in pii.KINDS]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in out)
    return (*n, hashlib.sha256(joined.encode()).hexdigest()), joined


BITS = ["a@b.c", "x.y+z@mail", ".com", "@", ".", "+", "-", " ", "(", ")", "1", "12", "255.1.0", "300", "4111 1111 1111 1111", "4111-1111", "é",
        "𝒳", "+49 (30) 123-4567", "0000", "a", "_%", "\n", "192.168.0.1", "79927398713", "word", "ß٣"]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))), 1) for i in range(500)]
    rows += [(900, None, 1), (901, "", 1), (901, "", 1), (None, "q@r.st", 2), (902, "a" * 100000, 1), (903, "a@b" + ".c" * 30000, 1),
             (904, "1" * 50000, 1), (905, "1-" * 20000 + "x +1" + "(" * 30000, 1)]
    texts = {r[0]: r[1] for r in rows}
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        want, joined = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, texts[r.doc_id]
        assert r.spans == joined or r.spans.startswith(joined + ",term") or not joined


def leaking():
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(5))
    rows = [(i, f"{fill()} Zorblatt writes ann@x.org {fill()}") for i in range(6)]
    rows += [(10 + i, f"{fill()} mail{i}@y.org {fill()}") for i in range(50)]
    rows += [(100 + i, f"{fill()} copied frobnicate bob@z.org {fill}"[:60]) for i in range(1)] * 5  # one document, copied
    return rows


def test_terms_that_disclose_an_entity_are_marked(spark):
    docs = spark.createDataFrame(leaking(), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i in range(6):
        text = dict(leaking())[i]
        terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"}
        assert terms == {"Zorblatt", "writes"}
    assert all("term" not in got[i].spans for i in got if i >= 10)


def test_sanitised_texts(spark):
    rows = [(*r, 1) for r in leaking()[:46]] + [(500, None, 1), (501, "clean", 1)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, code int")).collect()}
    assert len(got) == 48 and got[500] is None and got[501] == "clean"
    assert "[TERM] [TERM] [EMAIL]" in got[0] and "@" not in "".join(t for t in got.values() if t)


def test_no_rows(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_far_from_their_entity_and_in_other_documents(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    rows = [(i, f"Quillfeather {fill(60)} ann@x.org {fill(5)}") for i in range(6)]
    rows += [(10 + i, f"{fill(8)} mail{i}@y.org {fill(8)}") for i in range(80)]
    rows += [(200, f"{fill(9)} QUILLFEATHER, {fill(9)} Quillfeathers quillfeather"), (201, "quillfeather@else.org")]
    texts = dict(rows)
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    terms = {i: [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].split(",") if s) if k == "term"] for i in got}
    assert all(terms[i] == ["Quillfeather"] for i in range(6))
    assert terms[200] == ["QUILLFEATHER", "quillfeather"] and terms[201] == []
    assert not any(terms[i] for i in range(10, 90))


def test_disclosed_terms_equal_brute_force(spark):
    import math

    rng = random.Random(12)
    people = [(f"Name{i}", f"user{i}@host{i}.org") for i in range(12)]
    fill = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(260):
        words = [rng.choice(fill) for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.5:
            name, mail = people[min(int(rng.expovariate(0.3)), 11)]
            words.insert(rng.randrange(len(words)), f"<{mail}>")
            if rng.random() < 0.8:
                words.insert(rng.randrange(len(words)), name)
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), f"Clue{mail[4]}")
        elif rng.random() < 0.3:
            words.append(rng.choice(people)[0].upper())
        rows.append((i, " ".join(words)))

    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    word = re.compile(r"[^\W_]{2,}")
    low = lambda text: [w.lower() for w in word.findall(text)]
    places, rests = {}, {}
    for d, text in rows:
        for m in mail.finditer(text):  # one a document
            before, after = text[max(0, m.start() - 121) : m.start()], text[m.end() : m.end() + 121]
            before = re.sub(r"^[^\W_]+", "", before) if len(before) > 120 else before
            after = re.sub(r"[^\W_]+\Z", "", after) if len(after) > 120 else after
            places[d] = (m[0].lower(), tuple(low(before)[-6:] + low(after)[:6]))
            rests[d] = mail.sub(lambda x: " " * len(x[0]), text)
    has_entity, around = {}, {}
    for e, a in places.values():
        has_entity[e] = has_entity.get(e, 0) + 1
        around.setdefault(e, set()).add(a)
    has_term = {}
    for _, text in rows:
        for t in set(low(text)):
            has_term[t] = has_term.get(t, 0) + 1
    want = set()
    for e, n in has_entity.items():
        own = [d for d in places if places[d][0] == e]
        for t in {t for d in own for t in low(rests[d])}:
            both = [d for d in own if t in low(rests[d]) or t in places[d][1]]
            share = len(both) / max(has_term[t], len(both))
            if len(around[e]) >= pii.CONTEXTS and len({places[d][1] for d in both}) >= pii.CONTEXTS and share >= pii.SHARE:
                if math.log2(share / (n / len(rows))) >= pii.BITS:
                    want.add(t)
    assert len(want) >= 5 and any(t.startswith("clue") for t in want)
    texts = dict(rows)
    again = rows + rows[::2] * 3  # repeated rows are one document, and get its result each
    found = [r for some in (rows, again) for r in pii.report(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()]
    assert len(found) == len(rows) + len(again)
    for r in found:
        got = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term")]
        rest = rests.get(r.doc_id, texts[r.doc_id])
        assert got == [m.span() for m in word.finditer(rest) if m[0].lower() in want], r.doc_id


def test_many_places_in_long_texts_take_linear_time(spark):
    import time

    def seconds(text):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = docs.select(pii.base_spans(pii.F.col("text")).alias("b"), pii._rest(pii.F.col("text")).alias("r")).first()
        took = time.perf_counter() - start
        want, joined = brute(text)
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.b) == joined and len(row.r) == len(text)
        taken = [s for s in row.b]
        assert all(row.r[s.start : s.end].isspace() for s in taken)
        return took

    seconds("a@b.cd " * 10)
    assert seconds("é person.one@mail.example.org, 10.2.3.4 and +49 30 1234567 or 4111 1111 1111 1111 " * 3_000) < 60
    assert seconds("é " * 200_000 + " a@b.cd" * 3_000) < 30
