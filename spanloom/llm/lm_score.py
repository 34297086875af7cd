"""Cross-entropy difference between a target and a background n-gram model.

All words of the corpus are the one vocabulary of both models, with one class for unknown words.  The
background model counts the bigrams of every document, the target model those of documents whose labels
say they are good.  The models are matched: counts of the background are scaled to the size of the
target, and both are smoothed towards their own unigrams with the same weight.  With ``s`` the scale,
1 for the target,

    P(w | h) = (s n(h, w) + PRIOR u(w)) / (s n(h) + PRIOR),   u(w) = (s n(w) + 1) / (s N + words + 1)

A document's score is the mean over its words of the loss under the target minus the loss under the
background.  Losses are added as integers, so the order makes no difference.

The work is three passes over the texts and one shuffle of words:

* Words are counted; the counts are a written table.  Those that make up one part in ``FREQUENT`` of
  all, ``FREQUENT`` words at most, are sent to all tasks.
* Bigrams of two words with one part in ``HOT`` are counted; those with one part in ``HOT_PAIRS`` are
  sent to all tasks as well.
* Every other word goes, with its document, to where its bigram is counted: frequent words by the
  bigram, others by the word, so that its unigram counts are there too.  What it adds to the
  document's loss comes back, summed by document.  No key of this shuffle holds more than one part in
  ``HOT`` of all words.  Words and sums travel packed, by the bucket of their key and by the chunk of
  texts that they come from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words as W
from spanloom.session import Workspace

#: Weight of the unigrams, in words, in each history's distribution.
PRIOR = 20.0
#: Shares of all words, as one part in so many, that make a word or a bigram known to all tasks.
RANK_BITS = 17
FREQUENT, HOT, HOT_PAIRS = 1 << RANK_BITS, 1 << 11, 1 << 16
#: Words of the corpus in a bucket, about.
BUCKET = 1 << 21
#: Targets that are sent to all tasks at most, eight bytes each; more are joined by shuffling the texts once.
MARKS = 1 << 24
#: Units of a loss in one nat.
UNITS = 1 << 30

#: The history of a text's first word.
START = 1

_RANK = np.uint64(FREQUENT - 1)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def _lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(values), -1)
    spot = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[spot] == values, spot, -1)


class Models:
    """The sizes of both models, and what all tasks know: frequent words and hot bigrams."""

    def __init__(self, words: int, totals: tuple[int, int], starts: tuple[int, int], word: np.ndarray, n, t, hn, ht):
        self.words, self.totals = words, totals
        self.scale = (totals[1] / totals[0] if totals[0] and totals[1] else 1.0, 1.0)
        order = np.argsort(word)
        self.word, counts = word[order], [(n[order], hn[order]), (t[order], ht[order])]
        self.hot = self.word[counts[0][0] * HOT >= totals[0]]
        self.unigram = [self.prior(k, own) for k, (own, _) in enumerate(counts)]
        self.history = [self.denominators(k, own) for k, (_, own) in enumerate(counts)]
        self.start = [int(self.denominators(k, np.array([x]))[0]) for k, x in enumerate(starts)]
        self.pairs, self.pair_units = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 2

    def prior(self, k: int, counts: np.ndarray) -> np.ndarray:
        return PRIOR * (self.scale[k] * counts + 1.0) / (self.scale[k] * self.totals[k] + self.words + 1)

    def numerators(self, k: int, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return np.rint(np.log(self.scale[k] * counts + prior) * UNITS).astype(np.int64)

    def denominators(self, k: int, counts: np.ndarray) -> np.ndarray:
        return np.rint(np.log(self.scale[k] * counts + PRIOR) * UNITS).astype(np.int64)

    def add_pairs(self, pair: np.ndarray, n: np.ndarray, t: np.ndarray) -> None:
        order = np.argsort(pair)
        self.pairs = pair[order]
        last = _lookup(self.word, self.hot)[self.pairs % max(len(self.hot), 1)]
        self.pair_units = [self.numerators(k, c[order], self.unigram[k][last]) for k, c in enumerate((n, t))]

    def hot_pairs(self, word: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """A number for each bigram whose ends are hot (a text's start counts as hot), else -1."""
        place = _lookup(self.hot, word)
        before = np.full(len(word), len(self.hot))
        before[1:] = place[:-1]
        before[opens] = len(self.hot)
        return np.where((place >= 0) & (before >= 0), before * len(self.hot) + place, -1)


def _split(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, whether it is its text's first) of all words of a batch, split in small pieces."""
    rows, words, opens, base = [], [], [], 0
    for piece in W.pieces(iter([batch]), text):
        found = W.split(piece.column(text), W.ALPHANUMERIC)
        first = np.ones(len(found.doc), bool)
        first[1:] = found.doc[1:] != found.doc[:-1]
        rows.append(found.doc + base)
        words.append(found.hash)
        opens.append(first)
        base += piece.num_rows
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(words), np.concatenate(opens)


def _follows(opens: np.ndarray) -> np.ndarray:
    """Whether another word of the same text comes next."""
    return np.r_[~opens[1:], False] if len(opens) else opens


def _targets(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_target").to_numpy(zero_copy_only=False).astype(bool)


def _marker(marks):
    """For batches with ``_mark``, a code of their key: the same with ``_target``; None leaves them as they are."""

    def mark(batches):
        for batch in batches:
            if marks is not None:
                target = _lookup(marks.value, batch.column("_mark").to_numpy()) >= 0
                names = [n for n in batch.schema.names if n != "_mark"]
                batch = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(target)], [*names, "_target"])
            yield batch

    return mark


def _longs(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def word_counts(rows: DataFrame, text: str, mark) -> DataFrame:
    """word, and how often it stands and is followed: n and hn in all texts, t and ht in the target's."""
    names = ["word", "n", "t", "hn", "ht"]

    def count(batches):
        for batch in W.pieces(mark(batches), text, 8 * W.CHUNK_BYTES):
            row, word, opens = _split(batch, text)
            target, follows = _targets(batch)[row], _follows(opens)
            order = np.argsort(word)
            at = _starts(word[order])
            sums = [_sums(x[order], at) for x in (np.ones(len(row)), target, follows, follows & target)]
            yield _longs([word[order][at].view(np.int64), *sums], names)

    counts = rows.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return counts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names[1:]))


def hot_pair_counts(rows: DataFrame, models, text: str, mark) -> DataFrame:
    """pair (see :meth:`Models.hot_pairs`), n, t."""

    def count(batches):
        for batch in W.pieces(mark(batches), text, 8 * W.CHUNK_BYTES):
            row, word, opens = _split(batch, text)
            pair = models.value.hot_pairs(word, opens)
            own = pair >= 0
            pair, target = pair[own], _targets(batch)[row[own]]
            order = np.argsort(pair)
            at = _starts(pair[order])
            yield _longs([pair[order][at], _sums(np.ones(len(pair)), at), _sums(target[order], at)], ["pair", "n", "t"])

    counts = rows.mapInArrow(count, "pair long, n long, t long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


# A blob holds parallel arrays; the bytes of one place in all numbers stand together, which packs better.
_RARE = [("<u8", "word"), ("<u8", "history"), ("<u4", "doc")]
_COMMON = [("<u8", "pair"), ("<u4", "doc")]


def _pack(n_target: int, rare: list[np.ndarray], common: list[np.ndarray]) -> bytes:
    parts = [np.array([n_target, len(rare[0]), len(common[0])], "<u4").tobytes()]
    for (kind, _), values in zip([*_RARE, *_COMMON], [*rare, *common], strict=True):
        parts.append(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes())
    return b"".join(parts)


def _unpack(blob: bytes) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    n_target, *sizes = np.frombuffer(blob[:12], "<u4").tolist()
    at, out = 12, []
    for (kind, _), n in zip([*_RARE, *_COMMON], [sizes[0]] * len(_RARE) + [sizes[1]] * len(_COMMON), strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * width
    return n_target, out[: len(_RARE)], out[len(_RARE) :]


# A chunk is a run of texts that are read at once.  What is known of their losses travels as one blob, to
# which the buckets' blobs are added; `keys` and `n_words` say what the texts are.
_SUMS = [("<u4", "doc"), ("<i8", "background"), ("<i8", "target")]
TRAVELLING = ["bucket", "chunk", "sums", "keys", "n_words", "words"]


def _pack_sums(doc: np.ndarray, losses: list[np.ndarray]) -> bytes:
    return b"".join(x.astype(kind).tobytes() for (kind, _), x in zip(_SUMS, [doc, *losses], strict=True))


def _unpack_sums(blob: bytes) -> list[np.ndarray]:
    n = len(blob) // 20
    return [np.frombuffer(blob, kind, n, at * n) for (kind, _), at in zip(_SUMS, (0, 4, 12), strict=True)]


def _dealt(models, key: str, text: str, buckets: int, mark):
    """For each chunk of texts a row with the losses that are known here, and the other words by bucket."""

    def pieces(rare: list[np.ndarray], common: list[np.ndarray]):
        # Both are sorted by their key, of which the upper half gives the bucket.
        owns = [((k[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) for k in (rare, common)]
        for bucket in np.union1d(*owns).tolist():
            cuts = [slice(*np.searchsorted(own, np.array([bucket, bucket + 1], np.uint64))) for own in owns]
            yield int(bucket), [x[cuts[0]] for x in rare], [x[cuts[1]] for x in common]

    def run(batches):
        known = models.value
        row = TaskContext.get().partitionId() << 36
        for batch in W.pieces(mark(batches), text, 8 * W.CHUNK_BYTES):
            # Texts of the target come first: a document's number tells which model counts it.
            target = _targets(batch)
            batch = batch.take(pa.array(np.argsort(~target, kind="stable")))
            doc, word, opens = _split(batch, text)
            m = batch.num_rows
            place = _lookup(known.word, word)
            before, history = np.full(len(word), -1), np.zeros(len(word), np.uint64)
            before[1:], history[1:] = place[:-1], word[:-1]
            before[opens], history[opens] = len(known.word), START
            pair = _lookup(known.pairs, known.hot_pairs(word, opens))
            losses = []
            for k in range(2):
                units = np.zeros(m, np.int64)
                own = before >= 0
                np.add.at(units, doc[own], np.r_[known.history[k], known.start[k]][before[own]])
                own = pair >= 0
                np.add.at(units, doc[own], -known.pair_units[k][pair[own]])
                losses.append(units)
            number = doc.astype(np.uint32) << np.uint32(1) | _follows(opens).astype(np.uint32)
            own = np.flatnonzero(place < 0)
            own = own[np.argsort(word[own])]
            rare = [word[own], W.mix(history[own]) >> np.uint64(16), number[own]]
            own = np.flatnonzero((place >= 0) & (pair < 0))
            code = W.mix(W.mix(history[own]) + word[own]) & ~_RANK | place[own].astype(np.uint64)
            by = np.argsort(code)
            common = [code[by], number[own[by]]]
            edges = pa.array([0, m], pa.int32())
            made = [(bucket, _pack(int(target.sum()), r, c)) for bucket, r, c in pieces(rare, common)]
            lists = [pa.ListArray.from_arrays(edges, x) for x in (batch.column(key), pa.array(np.bincount(doc, minlength=m)))]
            lists = [pa.concat_arrays([x, pa.nulls(len(made), x.type)]) for x in lists]
            buckets_of = pa.array([int(row % buckets), *(b for b, _ in made)], pa.int32())
            sums = pa.array([_pack_sums(np.arange(m), losses)] + [None] * len(made), pa.binary())
            columns = [buckets_of, pa.array(np.full(len(made) + 1, row)), sums, *lists, pa.array([None, *(w for _, w in made)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, TRAVELLING)
            row += m

    return run


def _gathered(blobs: list[tuple[int, bytes]]) -> list[list[np.ndarray]]:
    """Of rare and of common words: key columns, document, whether the target counts it, whether a word follows."""
    out: list[list[list[np.ndarray]]] = [[[] for _ in range(len(kinds) + 2)] for kinds in (_RARE, _COMMON)]
    for first, blob in blobs:
        n_target, *both = _unpack(blob)
        for to, (*keys, number) in zip(out, both, strict=True):
            doc = (number >> np.uint32(1)).astype(np.int64)
            for column, values in zip(to, [*keys, first + doc, doc < n_target, (number & 1).astype(bool)], strict=True):
                column.append(values)
    return [[np.concatenate(column) for column in columns] for columns in out]


def _each(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of n rows is in."""
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))


def settle(known: Models, blobs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Of one bucket's words: documents, and what the words add to their losses under both models."""
    rare, common = _gathered(blobs)
    order = np.lexsort((rare[1], rare[0]))
    word, history, doc, target, follows = (x[order] for x in rare)
    words, pairs = _starts(word), _starts(word, history)
    word_of = np.searchsorted(words, pairs, side="right") - 1
    order = np.argsort(common[0], kind="stable")
    code, doc_c, target_c, _ = (x[order] for x in common)
    codes = _starts(code)
    docs = np.concatenate([doc, doc_c])
    order = np.argsort(docs, kind="stable")
    own = _starts(docs[order])
    out = [docs[order][own]]
    for k, (seen, seen_c) in enumerate(((np.ones_like(target), np.ones_like(target_c)), (target, target_c))):
        prior = known.prior(k, _sums(seen, words))[word_of]
        numerators = known.numerators(k, _sums(seen, pairs), prior)[_each(pairs, len(word))]
        denominators = known.denominators(k, _sums(seen & follows, words))[_each(words, len(word))]
        prior = known.unigram[k][(code[codes] & _RANK).astype(np.int64)]
        numerators_c = known.numerators(k, _sums(seen_c, codes), prior)[_each(codes, len(code))]
        out.append(_sums(np.concatenate([denominators * follows - numerators, -numerators_c])[order], own))
    return out


def _settled(models):
    """Of rows sorted by bucket: those with texts as they are, and for each chunk what its words in the bucket add."""
    names = TRAVELLING[1:-1]

    def made(held, batch):
        doc, background, target = settle(models.value, held)
        chunks = np.unique([first for first, _ in held])
        cuts = [*np.searchsorted(doc, chunks).tolist(), len(doc)]
        sums = [_pack_sums(doc[a:b] - c, [background[a:b], target[a:b]]) for a, b, c in zip(cuts[:-1], cuts[1:], chunks, strict=True)]
        none = [pa.nulls(len(chunks), batch.schema.field(n).type) for n in ("keys", "n_words")]
        return pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(sums, pa.binary()), *none], names)

    def run(batches):
        bucket, held, last = None, [], None
        for batch in batches:
            words, last = batch.column("words"), batch
            if words.null_count:
                yield batch.filter(words.is_null()).select(names)
            packed = batch.filter(words.is_valid()).select(["bucket", "chunk", "words"])
            for own, chunk, blob in zip(*(column.to_pylist() for column in packed.columns), strict=True):
                if held and own != bucket:
                    yield made(held, batch)
                    held = []
                bucket = own
                held.append((chunk, blob))
        if held:
            yield made(held, last)

    return run


def _added(batches):
    """Of rows sorted by chunk: one for each text."""
    chunk, held = None, []

    def made():
        own = next(r for r in held if r["keys"] is not None)
        sums = np.zeros((2, len(own["keys"])), np.int64)
        for row in held:
            doc, *losses = _unpack_sums(row["sums"])
            for k in range(2):
                sums[k, doc] += losses[k]  # each document once in a blob
        return own["keys"], own["n_words"], sums

    def batch_of(parts, kind):
        keys = pa.array([k for p in parts for k in p[0]], kind)
        return pa.RecordBatch.from_arrays([keys, pa.array([n for p in parts for n in p[1]], pa.int64()), *(pa.array(np.concatenate([p[2][k] for p in parts])) for k in range(2))], ["key", "n_words", "background", "target"])

    kind = None
    for batch in batches:
        kind, done = batch.schema.field("keys").type.value_type, []
        for row in batch.to_pylist():
            if held and row["chunk"] != chunk:
                done.append(made())
                held.clear()
            chunk = row["chunk"]
            held.append(row)
        if done:
            yield batch_of(done, kind)
    if held:
        yield batch_of([made()], kind)


def fit(rows: DataFrame, text: str, work: Workspace, mark) -> Models:
    """Count words and hot bigrams; ``mark`` gives batches of ``rows`` their ``_target``."""
    session = rows.sparkSession
    words = work.save(word_counts(rows, text, mark), "words")
    total = words.agg(F.count("*").alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t", "hn", "ht"))).first()
    known = words.where(F.col("n") * FREQUENT >= total.n).toArrow()
    columns = [known.column(c).to_numpy() for c in ("word", "n", "t", "hn", "ht")]
    # What no word precedes follows a text's start.
    models = Models(total.words, (total.n, total.t), (total.n - total.hn, total.t - total.ht), columns[0].view(np.uint64), *columns[1:])
    sent = session.sparkContext.broadcast(models)
    pairs = hot_pair_counts(rows, sent, text, mark).where(F.col("n") * HOT_PAIRS >= total.n).toArrow()
    sent.unpersist()
    models.add_pairs(*(pairs.column(c).to_numpy() for c in ("pair", "n", "t")))
    return models


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality = 1 and toxic = 0") -> DataFrame:
    """One row per input row: doc_id, n_words, loss_difference, target_loss, background_loss.

    Losses are in nats a word: the smaller the difference, the more like the target; null for a null,
    empty or blank text.  Labels that are null are no targets; a document with several labels is a
    target if one says so.  Without targets the target model is uniform.  Repeated rows count as
    often as they stand and give repeated results.  Other columns are not read.
    """
    session = docs.sparkSession
    work = Workspace(session, "lm-score")
    good = work.save(labels.where(F.expr(target) & F.col(key).isNotNull()).select(key).distinct(), "targets")
    if good.count() <= MARKS:
        codes = np.sort(good.select(F.xxhash64(key).alias("code")).toArrow().column("code").to_numpy())
        mark = _marker(session.sparkContext.broadcast(codes))
        rows = docs.select(key, text, F.xxhash64(key).alias("_mark"))
    else:
        mark = _marker(None)
        rows = docs.select(key, text).join(good.withColumn("_hit", F.lit(True)), key, "left")
        rows = work.save(rows.select(key, text, F.coalesce("_hit", F.lit(False)).alias("_target")), "marked")
    models = fit(rows, text, work, mark)
    sent = session.sparkContext.broadcast(models)
    buckets = models.totals[0] // BUCKET + 1
    kind = docs.schema[key].dataType.simpleString()
    fields = f"chunk long, sums binary, keys array<{kind}>, n_words array<long>"
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.mapInArrow(_dealt(sent, key, text, buckets, mark), f"bucket int, {fields}, words binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_settled(sent), fields)
    dealt = dealt.repartition(parts, "chunk").sortWithinPartitions("chunk")
    sums = dealt.mapInArrow(_added, f"key {kind}, n_words long, background long, target long")
    mean = lambda c: c / F.lit(float(UNITS)) / F.when(F.col("n_words") > 0, F.col("n_words"))
    return sums.select(
        F.col("key").alias(key),
        "n_words",
        mean(F.col("target") - F.col("background")).alias("loss_difference"),
        mean(F.col("target")).alias("target_loss"),
        mean(F.col("background")).alias("background_loss"),
    )
