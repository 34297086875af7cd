"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Fixed kinds of personal data (e-mail, IP and card numbers, phone numbers) are found by pattern.  Each
value is a protected entity.  For the words of the documents that hold an entity the corpus tells how
strongly they reveal it: over the documents that have word ``t`` and entity ``e``, all that have ``t``,
all that have ``e`` and all there are, a word discloses the entity if

    P(e | t) >= SHARE   and   log2( P(e | t) / P(e) ) >= BITS

and at least ``CONTEXTS`` different surroundings of the entity support it, so that copies of one
document are no evidence: each document gives one, and each place with the word near the entity its own.
Such words are marked wherever they stand, in every text, and generalised there.  As P(e | t) is at
most the number of documents with ``e`` over that with ``t``, common words end before they meet entities.

Patterns are written so that Java's engine needs neither recursion nor repeated attempts inside a
run of characters; they match exactly what the plain forms in the comments match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import selecting
from spanloom.session import Workspace

SHARE, BITS, CONTEXTS = 0.5, 3.0, 3
#: Words on either side of an entity, at most, within so many code points.
NEAR_WORDS, NEAR_CHARS = 6, 120

KINDS = ("email", "ip", "card", "phone")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   A run of local characters is tried once, at its
# first place or where the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+
_CARD = r"[0-9](?:[ -]?[0-9])++"
# \+[0-9][\x20().0-9-]+[0-9]
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{N}]{2,}+"

# What stands for the kinds' matches where they are blanked, one character at a time, so that places stay:
# a match is looked for ahead at its first character, and the run of its characters is followed from there.
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_BLANKED = {
    "email": r"(?:\G(?!^)|(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]))[A-Za-z0-9._%+@-]",
    "ip": rf"(?:\G(?!^)|(?<![0-9])(?={_PART}(?:\.{_PART}){{3}}(?![0-9])))[0-9.]",
    "card": r"(?:\G(?!^)|(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])))[0-9 -]",
    "phone": r"(?:\G(?!^)|(?=\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])))[+0-9 ().-]",
}

_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
_NONE = f"cast(array() as {_SPAN})"


def found(text: Column, pattern: str | Column) -> Column:
    """All matches with their places, in code points, and what stands before and after, up to ``NEAR_CHARS`` and one more.

    Places come from the lengths of what stands between the matches: running sums within blocks of
    about the root of their number, so that many matches do not cost their square.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    # Zipped, so that the text is split once and not for each match; the last piece has no match.
    pairs = F.zip_with(between, matches, lambda b, m: F.struct(b.alias("gap"), m.alias("match")))
    ones = F.zip_with(pairs, F.slice(between, 2, 1 << 30), lambda p, after: F.struct(
        F.length(p["gap"]).alias("gap"), p["match"].alias("match"), F.right(p["gap"], F.lit(NEAR_CHARS + 1)).alias("before"), F.left(after, F.lit(NEAR_CHARS + 1)).alias("after")
    ))
    ones = F.filter(ones, lambda p: p["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out"))

    def step(done: Column, own: Column) -> Column:
        begin = done["at"] + own["gap"]
        end = begin + F.length(own["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), own["match"].alias("match"), own["before"].alias("before"), own["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    def moved(done: Column, block: Column) -> Column:
        spans = F.struct(done["at"].alias("by"), block["out"].alias("out"))
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["out"], F.array(spans)).alias("out"))

    def placed(block: Column) -> Column:
        return F.transform(block["out"], lambda s: F.struct(
            (s["start"] + block["by"]).alias("start"), (s["end"] + block["by"]).alias("end"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")
        ))

    # A lambda's argument is computed once where text functions would be repeated.
    def spans(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(own) - 1, size), lambda i: F.aggregate(F.slice(own, i + 1, size), start, step))
        whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<by:int,out:{_SPAN}>>)").alias("out")), moved, lambda d: d["out"])
        few = F.aggregate(own, start, step, lambda d: d["out"])
        return F.when(F.size(own) <= 32, few).otherwise(F.flatten(F.transform(whole, placed)))

    return F.element_at(F.transform(F.array(ones), spans), 1)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda total, i: total
        + F.when((F.length(digits) - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


# What a text must have before its matches are looked for.
_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, match): the fixed kinds, as listed, then by place."""
    return reduce(F.concat, [_kind_spans(text, k, p) for k, p in zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True)])


def _kind_spans(text: Column, kind: str, pattern: str) -> Column:
    spans = F.when(_GATES[kind](text), found(text, pattern)).otherwise(F.expr(_NONE))
    spans = F.filter(spans, lambda s: _valid(kind, s["match"]))
    named = lambda s: F.struct(F.lit(kind).alias("kind"), *(s[f].alias(f) for f in ("start", "end", "match", "before", "after")))
    return F.transform(spans, named)


def _near(span: Column) -> Column:
    """Words on both sides of a span, up to the next span of its kind; words cut by the window's edge are left out."""
    whole = lambda side, cut: F.when(F.length(span[side]) <= NEAR_CHARS, span[side]).otherwise(F.regexp_replace(span[side], cut, ""))
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    left = words(whole("before", r"^[\p{L}\p{N}]+"))
    left = F.slice(left, F.greatest(F.size(left) - NEAR_WORDS + 1, F.lit(1)), NEAR_WORDS)
    return F.concat(left, F.slice(words(whole("after", r"[\p{L}\p{N}]+\z")), 1, NEAR_WORDS))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["match"])).when(span["kind"] == "ip", span["match"]).otherwise(_digits(span["match"]))
    return F.concat_ws(":", span["kind"], value)


def _rest(text: Column) -> Column:
    """The text with personal data overwritten by blanks, which keeps all places.

    What is written on to an address, and numbers that only a checksum tells from a card's, go as well.
    """
    return reduce(lambda t, kind: F.when(_GATES[kind](text), F.regexp_replace(t, _BLANKED[kind], " ")).otherwise(t), KINDS, text)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def disclosing(inside: DataFrame, held: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """(entity, term) pairs above the thresholds; ``inside`` has doc, entity, around and words of each place."""
    entities = inside.groupBy("entity").agg(F.count_distinct("doc").alias("has_entity"), F.count_distinct("around").alias("contexts"))
    entities = work.save(entities.where(F.col("contexts") >= CONTEXTS).drop("contexts"), "entities")
    holders = inside.groupBy("doc", "entity").agg(F.min("around").alias("around")).join(entities, "entity")
    holders = work.save(holders, "holders")
    most = work.save(holders.groupBy("doc").agg(F.max("has_entity").alias("most")), "most")
    said = held.where("rest is not null").select("doc", "rest").dropDuplicates(["doc"]).join(most, "doc")
    said = said.select("doc", "most", F.explode(F.array_distinct(F.transform(_words(F.col("rest")), F.lower))).alias("term"))
    # A term is in as many documents at least as have it and an entity: common words end here.
    limit = F.col("n") * SHARE
    some = work.save(said.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("most")).where(limit <= F.col("most")).drop("most"), "some")
    rare = work.save(said.join(some, "term").where(limit <= F.col("most")).select("doc", "term", "n"), "rare")
    whole = rare.join(holders, "doc").where(limit <= F.col("has_entity")).select("entity", "term", "doc", "around")
    near = inside.select("entity", "doc", "around", F.explode(F.array_distinct("words")).alias("term"))
    contexts = whole.union(near.select("entity", "term", "doc", "around").join(entities.select("entity"), "entity", "left_semi"))
    pairs = contexts.groupBy("entity", "term").agg(F.count_distinct("doc").alias("both"), F.count_distinct("around").alias("contexts"))
    pairs = work.save(pairs.where(F.col("contexts") >= CONTEXTS).drop("contexts"), "pairs")
    terms = work.save(pairs.select("term").distinct(), "terms")
    # Repeated rows are one document everywhere: each of k counts for a k-th of it.
    copies = work.save(held.groupBy("doc").count(), "copies")
    total = copies.count()
    repeated = copies.where("count > 1")
    many = repeated.count()
    every = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("doc"), "text", F.lit(1).alias("count"))
    if many:
        every = every.drop("count").join(F.broadcast(repeated) if many <= selecting.BROADCAST_KEYS else repeated, "doc", "left")
    every = every.select((1 / F.coalesce("count", F.lit(1))).alias("part"), F.explode(F.array_distinct(F.transform(_words(F.col("text")), F.lower))).alias("term"))
    seen = selecting.keep(every, terms, "term").groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("has_term"))
    share = F.col("both") / F.greatest("has_term", "both")
    bits = F.log2(share / (F.col("has_entity") / F.lit(float(max(total, 1)))))
    joined = pairs.join(seen, "term").join(entities, "entity")
    return work.save(joined.where((share >= SHARE) & (bits >= BITS)).select("entity", "term"), "disclosing")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, code (of the text), base and terms, arrays of spans.

    A span has kind, start and end (code points, end exclusive) and match; terms that disclose an
    entity have the kind ``term``, stand outside the base spans, and are marked in every text.  Null
    counts as empty; an empty text has no spans; a repeated row gives a repeated result; other columns
    are not read.
    """
    work = Workspace(docs.sparkSession, "pii")
    slim = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    based = slim.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    some = F.size("base") > 0
    near = F.when(some, F.transform("base", lambda s: F.struct(_entity(s).alias("entity"), _near(s).alias("words"))))
    rest = F.when(some, _rest(F.col("text")))
    code = F.xxhash64("text")
    base = F.transform("base", lambda s: F.struct(*(s[f].alias(f) for f in ("kind", "start", "end", "match"))))
    held = based.select("doc_id", code.alias("code"), F.xxhash64("doc_id", code).alias("doc"), base.alias("base"), near.alias("near"), rest.alias("rest"))
    held = work.save(held, "base")
    inside = held.where("near is not null").select("doc", F.inline("near"))
    inside = inside.withColumn("around", F.xxhash64("words"))
    leaks = disclosing(inside, held, slim, work)
    terms = work.save(leaks.select("term").distinct(), "leaks")
    spelt = slim.select("doc_id", code.alias("code"), F.explode(_words(F.col("text"))).alias("word")).withColumn("term", F.lower("word"))
    spelt = selecting.keep(spelt, terms, "term").groupBy("doc_id", "code").agg(F.collect_set("word").alias("spelt"))
    spelt = work.save(spelt.select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), "spelt"), "spelt")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("code") == F.col("_code"))
    few = spelt.count() <= selecting.BROADCAST_KEYS // 16
    texts = slim.select("doc_id", code.alias("code"), "text")
    texts = texts.join(F.broadcast(spelt) if few else spelt, same).dropDuplicates(["_id", "_code"]).select("_id", "_code", "spelt", "text")
    rests = held.where("rest is not null").select("doc_id", "code", "rest").dropDuplicates(["doc_id", "code"])
    texts = texts.join(rests, same, "left").select("_id", "_code", "spelt", F.coalesce("rest", "text").alias("text"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort("spelt"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    at = F.transform(found(F.col("text"), pattern), lambda s: F.struct(
        F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("match")
    ))
    marked = work.save(texts.select("_id", "_code", at.alias("terms")), "marked")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,match:string>>)")
    return held.drop("near", "rest", "doc").join(marked, same, "left").select("doc_id", "code", "base", F.coalesce("terms", none).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and a digest of the fixed kinds, and all spans."""
    got = spans(docs, key, text)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        F.col("doc_id").alias(key),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "terms")).alias("spans"),
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind and disclosing terms generalised.

    Overlapping spans become one, named after the first; a term that is a number becomes [NUMBER],
    another [TERM].  A null text stays null.
    """
    got = spans(docs, key, text).select("doc_id", "code", F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["match"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]")).alias("tag"),
    ))).alias("marks")).dropDuplicates(["doc_id", "code"])
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    same = F.col("_key").eqNullSafe(F.col("doc_id")) & (F.xxhash64("_text") == F.col("code"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(done: Column, m: Column) -> Column:
        piece = F.concat(F.substr("_text", done["at"] + 1, m["start"] - done["at"]), m["tag"])
        ahead = F.struct(m["end"].alias("at"), F.concat(done["out"], F.array(piece)).alias("out"))
        wider = F.struct(F.greatest(done["at"], m["end"]).alias("at"), done["out"].alias("out"))
        return F.when(m["start"] >= done["at"], ahead).otherwise(wider)

    clean = F.aggregate("marks", start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substr("_text", d["at"] + 1)))
    joined = packed.join(got, same, "left").select("_row.*", F.when(F.size("marks") > 0, clean).alias("_clean"))
    return joined.withColumn(text, F.coalesce("_clean", F.col(text))).select(*docs.columns)
