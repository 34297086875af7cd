import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def cases(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "ünd", "the"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([0, 3, 9, 10, 11, 25]))) for i in range(12)] + [(3, "extra x y"), (90, None), (None, say(12))]
    docs = []
    for i in range(n):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", say(rng.randint(0, 5))]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "the " * 5000), (100, None), (3, docs[3][1]), (None, docs[4][1])]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = cases()
    # An extra column with a clashing name is ignored.
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_words long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [x for x in items if x[0] is not None])
    assert sorted((tuple(r) for r in decontam.report(frame, bench).collect()), key=str) == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = cases(5)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [x for x in items if x[0] is not None])
    assert sorted((tuple(r) for r in decontam.report(frame, bench).collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontam.report(docs, none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)
    assert decontam.report(docs.where("false"), none).count() == 0


def test_passages_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Keep this. {item.upper()}! And thät.", "en", 5), (2, item, "en", 6), (3, None, None, None), (4, "clean", "en", 5)],
        "doc_id long, text string, lang string, n_chars long",
    )
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert got[1].text == "Keep this. \n! And thät." and got[1].n_chars == len(got[1].text)
    assert set(got) == {1, 3, 4} and got[3].text is None and got[4].n_chars == 5
    assert decontam.decontaminate(docs, bench).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_every_place(values, pattern):
    text = np.array([*values, 0, *values, -1], np.int64)
    index = decontam.FMIndex(text, 4)

    class One:
        lengths = np.array([len(pattern)])
        symbols = np.array([pattern])

    phrase, low, high = index.search(One)
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(phrase) else []
    flat = text.tolist()
    assert got == [i for i in range(len(flat)) if flat[i : i + len(pattern)] == pattern]
