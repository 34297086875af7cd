import random
import re

import pyarrow as pa

from spanloom.llm import licenses
from spanloom.llm import words as W
from spanloom.llm.license_rules import rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted(
        (k, label)
        for phrase, label in licenses.PHRASES.items()
        for k in range(len(w))
        if w[k : k + len(phrase.split())] == phrase.split()
    )
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = [
    None,
    "",
    "Plain text, mit Licht under the sun.",
    "Released under the MIT License.",
    "under the mit; LICENSE! under the MIT license",
    "Apache License, Version 2.0 and CC BY-NC 4.0",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "Licensed under the GNU General Public License version 3",
    "été cc by nc ünder the mit license",
    "cc by ncx; xcc by nc",
    "a " * 20000 + "cc by nc",
]


def test_base_columns_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "cc by nc", None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by nc" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_method_adds_labels_and_suppresses_contained_ones(spark):
    rows = [(6, TEXTS[6]), (7, TEXTS[7]), (2, TEXTS[2])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6].labels == "gpl-3-or-later" and got[6].score == 1.0 and len(got[6].detections) == 1
    assert got[7].labels == "gpl-3" and len(got[7].detections) == 1  # the plain name lies inside the notice
    assert got[2].labels == "" and got[2].score == 0


def example(pattern, rng):
    """A random text that a pattern matches; the patterns' few constructs are enough."""
    from re import _constants as C
    from re import _parser as P

    def one(parts):
        out = []
        for kind, value in parts:
            if kind is C.LITERAL:
                out.append(chr(value))
            elif kind is C.IN:
                out.append("x" if value[0][0] is C.CATEGORY else chr(rng.choice([c for k, v in value for c in (range(v[0], v[1] + 1) if k is C.RANGE else [v])])))
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = value
                out += [one(inner) for _ in range(rng.randint(low, min(int(high), low + 2)))]
            elif kind is C.SUBPATTERN:
                out.append(one(value[3]))
            elif kind is C.BRANCH:
                out.append(one(rng.choice(value[1])))
            else:
                raise ValueError(kind)
        return "".join(out)

    return one(P.parse(pattern))


def test_every_rule_is_reached_through_its_gate():
    own, rng = rules(), random.Random(1)
    assert len(own) >= 400 and len({r.pattern for r in own}) >= 380 and all(r.gate for r in own)
    matcher = licenses.Matcher(own)
    for i, rule in enumerate(own):
        for _ in range(12):
            text = example(rule.pattern, rng)
            assert matcher.patterns[i].fullmatch(text), (rule, text)
            assert i in matcher.candidates(W.split(pa.array([text]), W.ALPHANUMERIC)).get(0, ()), (rule, text)


def test_gated_detections_equal_ungated_ones_and_suppression_is_containment():
    own, rng = rules(), random.Random(2)
    matcher = licenses.Matcher(own)
    for _ in range(400):
        parts = [example(rng.choice(own).pattern, rng) if rng.random() < 0.6 else rng.choice(["plain words here", "mit", "license", "gnu 2", "under"]) for _ in range(rng.randint(1, 4))]
        text = " ".join(parts)
        got = matcher.detect(text, matcher.candidates(W.split(pa.array([text]), W.ALPHANUMERIC)).get(0, []))
        assert got == matcher.detect(text, list(range(len(own))))
        every = []
        for i, p in enumerate(matcher.patterns):
            every += [(-own[i].priority, m.start() - m.end(), m.start(), i, m.end()) for m in p.finditer(text)]
        kept = []
        for x in sorted(every):
            if not any(k[2] <= x[2] and x[4] <= k[4] for k in kept):
                kept.append(x)
        words = lambda at: text[:at].count(" ")
        assert sorted(got) == sorted((x[3], words(x[2]), words(x[4]) + 1) for x in kept)


def test_short_forms_give_their_labels(spark):
    want = {
        "licensed under the gpl v2": "gpl-2", "released under GPL v3": "gpl-3", "LGPL v3": "lgpl-3", "agpl v3 license": "agpl-3", "0bsd license": "bsd-0",
        "FreeBSD license": "bsd-2", "OpenRAIL-M license": "openrail-m", "GNU Lesser General Public License v3": "lgpl-3", "Apache-2.0 license": "apache-2",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    for i, (text, label) in enumerate(want.items()):
        assert label in got[i], (text, got[i])


def test_plain_forms_expressions_and_denials(spark):
    want = {
        "GPLv2": {"gpl-2"}, "licensed under gplv3": {"gpl-3"}, "bsd 2 clause": {"bsd-2"}, "eupl 1.2": {"eupl-1.2"}, "licensed under the EUPL": {"eupl"}, "cc0 1.0 universal": {"cc0"},
        "creative commons attribution sharealike 4.0": {"cc-by-sa-4"}, "SPDX-License-Identifier: Apache-2.0 OR MIT": {"apache-2", "mit"}, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": {"apache-2", "mit", "bsd-3"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2-or-later"}, "SPDX-License-Identifier: MIT or something else": {"mit"}, "not licensed under the gpl v2": set(), "It is no longer distributed under the Apache License 2.0.": set(),
        "not licensed under the gpl v2 but released under the isc license": {"isc"}, "LGPLv2.1": {"lgpl-2.1"}, "GPL v3 or later": {"gpl-3-or-later"}, "SSPL": {"sspl-1"}, "AGPLv3 license": {"agpl-3"},
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (text, labels) in enumerate(want.items()):
        assert set(filter(None, got[i].labels.split(","))) == labels, (text, got[i])
    assert got[11].score == 0 and [d.kind for d in got[11].detections] == ["negated"]
    assert sorted((d.first_word, d.end_word, d.label) for d in got[8].detections) == [(0, 4, "mit"), (5, 8, "apache-2"), (9, 12, "bsd-3")]


def test_very_long_texts(spark):
    import time

    long = ["under the mit license and not licensed under the gpl v2 or " * 3_000, "spdx license identifier mit or apache 2 0 and " * 3_000, "word " * 300_000 + "gplv3"]
    start = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - start < 120
    assert got[0].labels == "mit" and got[0].n_base == 3_000 and got[1].labels == "apache-2,mit" and got[2].labels == "gpl-3"


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
