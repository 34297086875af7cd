import random
import re

from spanloom.llm import substring_dedup as D


def shingles(line):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, len(w)


def brute(rows):
    lines = []
    for d, t in rows:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            s, n = shingles(line)
            if n >= D.LEAST_WORDS:
                lines.append((d, k, at, at + len(line), n, s))
            at += len(line) + 1
    up = list(range(len(lines)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][5], lines[j][5]
            if 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(lines)):
        groups.setdefault(root(i), []).append(lines[i])
    return sorted(
        (*x[:5], *min(own)[:2], len(own), x[:2] != min(own)[:2]) for own in groups.values() if len(own) > 1 for x in own
    )


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("éa b c d e f g h i j k l".split()) + str(rng.randint(0, 40)) for _ in range(k)]
    passages = [say(rng.randint(35, 90)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                p = list(rng.choice(passages))
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    p[rng.randrange(len(p))] = say(1)[0]
                parts.append(" ".join(p) + rng.choice(["", ".", "!"]))
            else:
                parts.append(" ".join(say(rng.choice([3, 29, 30, 60]))).title())
        rows.append((i, "\n".join(parts)))
    return rows


def test_repeats_equal_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "\n\n"), (903, "a " * 40 + "\n" + "a " * 40)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string").repartition(3)
    got = D.repeated(frame).where("kind = 'line'").drop("kind").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_removed_lines_go_and_nothing_else(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"Start.\n{p}\nÉnd.", 9), (2, f"{p}!", 9), (3, f"other\n{p}", 9), (4, None, None), (5, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in D.remove_repeats(docs).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[3].text == "other\n" and got[3].n_chars == 6
    assert got[4].text is None and got[5] == (5, "clean", 5)


def test_null_ids_and_no_rows(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, p), (7, p), (7, p)], "doc_id long, text string")
    got = D.repeated(docs).collect()
    assert all(r.kind == "line" for r in got)  # its windows lie inside
    got = sorted(((r.doc_id, r.kept_doc_id, r.removed) for r in got), key=str)
    assert got == [(7, None, True), (7, None, True), (None, None, False)]
    assert D.repeated(docs.where("false")).count() == 0
    assert D.band_count(80, 5, 0.999) == 18


def test_passages_that_are_no_lines_equal_brute_force(spark):
    rng = random.Random(4)
    say = lambda k: [f"é{rng.randint(0, 5000)}" for _ in range(k)]
    passages = [say(rng.choice([51, 60, 140])) for _ in range(8)]
    rows = []
    for i in range(60):
        words = say(rng.randint(0, 200))
        if i % 2:
            words += [*passages[i % 8], *say(rng.randint(0, 90))]
        # Line ends stand anywhere, so that passages run over lines or lie inside longer ones.
        rows.append((i, "".join(w + rng.choice([" "] * 30 + [".\n"] if i % 4 else [" ", "\n"]) for w in words)))
    rows += [(900, None), (901, ""), (902, rows[1][1]), (902, rows[1][1]), (None, rows[3][1]), (None, "x")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string").repartition(3)
    got = D.repeated(docs).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {d: [(m[0].lower(), m.start(), m.end()) for m in word.finditer(t or "")] for d, t in rows if (d, t) != (None, "x")}
    grams: dict = {}
    for d, w in texts.items():
        for k in range(len(w) - D.LEAST_WORDS + 1):
            grams.setdefault(tuple(x[0] for x in w[k : k + D.LEAST_WORDS]), set()).add(d)
    spans: dict = {}
    for r in got:
        own = [x for x in texts[r.doc_id] if r.start <= x[1] and x[2] <= r.end]
        assert own[0][1] == r.start or r.kind == "line"
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.removed))
        if r.kind == "passage":  # nothing but what another document has, word for word
            assert len(own) == r.n_words and own[-1][2] == r.end
            parts = [grams[tuple(x[0] for x in own[k : k + D.LEAST_WORDS])] for k in range(len(own) - D.LEAST_WORDS + 1)]
            assert all(len(p) > 1 for p in parts) and {r.doc_id, r.kept_doc_id} <= set.intersection(*parts)
            order = lambda d: (d is not None, d)
            assert r.removed == (r.doc_id != r.kept_doc_id) and order(r.kept_doc_id) <= order(r.doc_id)
    for d, w in texts.items():  # any passage of more than 50 words is met
        for k in range(len(w) - 50):
            if all(len(grams[tuple(x[0] for x in w[i : i + D.LEAST_WORDS])]) > 1 for i in range(k, k + 51 - D.LEAST_WORDS + 1)):
                assert any(a < w[k + 50][2] and b > w[k][1] for a, b, _ in spans.get(d, ())), (d, k)
    left = {r.doc_id: r.text for r in D.remove_repeats(docs.drop("kind")).where("doc_id < 100").collect()}
    assert left[0] == rows[0][1]
    assert " ".join(passages[1][20:40]) in re.sub(r"\W+", " ", left[1]) and " ".join(passages[1][20:40]) not in re.sub(r"\W+", " ", left[9])
