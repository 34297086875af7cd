"""Licence scan: ordered signature rules behind a keyword prefilter.

The words of a whole batch of texts are hashed at once.  Keywords are looked up among the hashes, so
a rule's pattern is only tried on texts whose words open its gate.  Of the detections in a text, those
with the higher priority are kept first, then longer ones; a detection whose words all lie inside one
that is kept is suppressed, while two that only overlap both stand.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm import words as W
from spanloom.llm.license_rules import Rule, identifiers, rules

#: Fixed phrases whose places count, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

DETECTION = "struct<label:string,kind:string,first_word:long,end_word:long,weight:double>"


class Matcher:
    """The rules, compiled, with the hashes of their gates' words."""

    def __init__(self, own: list[Rule]):
        self.rules = own
        self.patterns = [rule.compiled() for rule in own]
        names = sorted({word for rule in own for place in rule.gate for word in place})
        hashes = W.word_hashes(names)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {names[j]: i for i, j in enumerate(order)}
        self.gates = [[frozenset(number[word] for word in place) for place in rule.gate] for rule in own]
        # Each rule is looked up by one place of its gate, whose words are in the fewest gates.
        share = Counter(word for gate in self.gates for place in gate for word in place)
        self.by_word: dict[int, list[int]] = {}
        for i, gate in enumerate(self.gates):
            for word in min(gate, key=lambda place: (sum(share[word] for word in place), min(place))):
                self.by_word.setdefault(word, []).append(i)

    def candidates(self, found: W.Words) -> dict[int, list[int]]:
        """Row to the rules whose gates its words open."""
        spot = np.minimum(np.searchsorted(self.hashes, found.hash), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[spot] == found.hash)
        pairs = np.unique(found.doc[at] * len(self.hashes) + spot[at])
        present: dict[int, set] = {}
        for row, word in zip((pairs // len(self.hashes)).tolist(), (pairs % len(self.hashes)).tolist(), strict=True):
            present.setdefault(row, set()).add(word)
        out = {}
        for row, words in present.items():
            tried = {i for word in words for i in self.by_word.get(word, ())}
            if own := sorted(i for i in tried if all(words & place for place in self.gates[i])):
                out[row] = own
        return out

    def detect(self, joined: str, candidates: list[int]) -> list[tuple[int, int, int]]:
        """Kept detections in a text of words joined by spaces: (rule, first word, end word)."""
        levels: dict[int, list[tuple[int, int, int]]] = {}
        for i in candidates:
            for match in self.patterns[i].finditer(joined):
                levels.setdefault(self.rules[i].priority, []).append((match.start(), -match.end(), i))
        if not levels:
            return []
        kept: list[tuple[int, int, int]] = []
        for priority in sorted(levels, reverse=True):
            # Of one priority the longer holds the shorter; of the same words the first rule stands.
            starts, ends = [k[0] for k in kept], list(itertools.accumulate((k[1] for k in kept), max))
            own, far = [], -1
            for start, end, i in sorted(levels[priority]):
                place = bisect.bisect_right(starts, start)
                if far < -end and not (place and ends[place - 1] >= -end):
                    own.append((start, -end, i))
                    far = -end
            kept = sorted(kept + own)
        spaces = [m.start() for m in re.finditer(" ", joined)]
        return [(i, bisect.bisect_left(spaces, a), bisect.bisect_left(spaces, b) + 1) for a, b, i in kept]


_JOINED = re.compile(" (?:or|and) ")


def expression(joined: str, spaces: list[int], end_word: int, known: list[tuple[str, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(label, first word, end word) of the identifiers that go on from one that ends at ``end_word``; ``spaces`` are the blanks' places."""
    out = []
    while end_word <= len(spaces) and (more := _JOINED.match(joined, spaces[end_word - 1])):
        found = [(m.end(), label) for label, p in known if (m := p.match(joined, more.end()))]
        if not found:
            break
        end, label = max(found)
        first = end_word + 1
        end_word = bisect.bisect_left(spaces, end) + 1
        out.append((label, first, end_word))
    return out


def _phrase_places(found: W.Words, phrase: np.ndarray) -> np.ndarray:
    """Index of the first word of each place where the phrase stands in one document."""
    n = len(phrase)
    if len(found.hash) < n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(found.hash[: len(found.hash) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[found.hash[at + k] == phrase[k]]
    return at[found.doc[at] == found.doc[at + n - 1]]


def _report(key: str, text: str):
    phrases = [(W.word_hashes(p.split()), label) for p, label in PHRASES.items()]
    made: list[Matcher] = []
    known = identifiers()

    def run(batches):
        if not made:
            made.append(Matcher(rules()))
        matcher = made[0]
        for batch in W.pieces(batches, text):
            found = W.split(batch.column(text), W.ALPHANUMERIC)
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: dict[int, set] = {}
            for phrase, label in phrases:
                at = _phrase_places(found, phrase)
                doc = found.doc[at]
                np.add.at(count, doc, 1)
                np.minimum.at(low, doc, at - found.first[doc])
                np.maximum.at(high, doc, at - found.first[doc])
                for row in np.unique(doc).tolist():
                    base.setdefault(row, set()).add(label)
            detected: dict[int, list[tuple[Rule, int, int]]] = {}
            lowered = None
            for row, candidates in matcher.candidates(found).items():
                if lowered is None:
                    lowered = W.ALPHANUMERIC[found.data]
                a, b = int(found.first[row]), int(found.first[row + 1])
                spans = zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)
                joined = b" ".join(lowered[s:e].tobytes() for s, e in spans).decode("utf-8", "replace")
                if kept := matcher.detect(joined, candidates):
                    own = [(matcher.rules[i], a, b) for i, a, b in kept]
                    if starts := [(rule, end) for rule, _, end in own if rule.kind == "identifier"]:
                        spaces = [m.start() for m in re.finditer(" ", joined)]
                        there = {(rule.label, a, b) for rule, a, b in own}
                        for rule, end in starts:
                            more = [x for x in expression(joined, spaces, end, known) if x not in there]
                            own += [(Rule(label, "identifier", "", (), rule.priority, rule.weight), a, b) for label, a, b in more]
                    detected[row] = own
            none = high < 0
            labels, base_labels, score, detections = [], [], [], []
            for row in range(n):
                own = detected.get(row, ())
                fixed = base.get(row, ())
                base_labels.append(",".join(sorted(fixed)))
                labels.append(",".join(sorted({*fixed, *(r.label for r, _, _ in own if r.kind != "negated")})))
                score.append(max([1.0 if fixed else 0.0, *(r.weight for r, _, _ in own)]))
                detections.append(
                    [
                        {"label": r.label, "kind": r.kind, "first_word": a, "end_word": b, "weight": r.weight}
                        for r, a, b in own
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(found.per_doc),
                    pa.array(count),
                    pa.array(low, mask=none),
                    pa.array(high, mask=none),
                    pa.array(base_labels, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(
                        detections,
                        pa.list_(
                            pa.struct(
                                [
                                    ("label", pa.string()),
                                    ("kind", pa.string()),
                                    ("first_word", pa.int64()),
                                    ("end_word", pa.int64()),
                                    ("weight", pa.float64()),
                                ]
                            )
                        ),
                    ),
                ],
                [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: places of the fixed phrases, labels, a score and the detections.

    Null and empty texts have no words, no labels and score 0.  Repeated rows give repeated results.
    Other columns are not read, so their names cannot clash.  ``score`` is 1 where a fixed phrase
    stands, else the largest weight of a kept detection.  Words are counted from 0, ends exclusive.  In
    an expression of identifiers every one gives its label; a notice that is taken back gives none.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        _report(key, text),
        f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, "
        f"base_labels string, labels string, score double, detections array<{DETECTION}>",
    )
