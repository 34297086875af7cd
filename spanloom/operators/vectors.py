"""Vector search over an embeddings table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.drift import cosine, dot

#: Queries that are sent to all tasks at once; more are searched block by block.
BLOCK = 4096
#: Pairs of which a task holds the scores at once, some tens of MB with what is made of them.
PAIRS = 1 << 20
#: Scores are rounded to six places before they are ranked.
DIGITS = 6


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclid":
        return 1 / (1 + F.sqrt(squares))
    if metric == "manhattan":
        return 1 / (1 + F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(metric)


def _scores(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows): similarities in double precision; nan where a zero vector has no direction."""
    if metric == "manhattan":
        return 1 / (1 + np.stack([np.abs(rows - q).sum(axis=1) for q in queries]))
    if metric == "euclid":
        return 1 / (1 + np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in queries]))
    out = queries @ rows.T
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            out = out / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(rows, axis=1)[None, :]
    elif metric != "dot":
        raise ValueError(metric)
    return out


def _valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compared(vectors: DataFrame, queries: DataFrame, metric: str, chosen: Callable, by_query: bool = False) -> DataFrame:
    """(query_id, vec_id, score) of the pairs that ``chosen(scores, query ids, ids)`` marks.

    The queries are a stated set: they are read in blocks of at most ``BLOCK``, each compared with all
    rows where these stand.  Vectors must have one length.  A batch of rows is compared in parts of at most
    ``PAIRS`` pairs: some of its rows with all queries of the block or, with ``by_query``, all its rows with some queries.
    """
    session, rows = vectors.sparkSession, _valid(vectors)
    own = _valid(queries)
    blocks = -(-own.count() // BLOCK)
    # Places by rank, so that no block is larger than it should be.
    placed = own.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(max(2 * blocks - 1, 1))) if blocks > 1 else F.lit(0))
    out = None
    for k in range(max(2 * blocks - 1, 1)):
        asked = placed.where(F.col("_block") == k).select("vec_id", "v").toArrow()
        sent = session.sparkContext.broadcast((asked.column("vec_id").to_numpy(), _matrix(asked.column("v")) if asked.num_rows else np.zeros((0, 0))))

        def compare(batches, sent=sent):
            ids, matrix = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
                step = max(PAIRS // (len(own) if by_query else len(ids)), 1)
                for k in range(0, len(ids) if by_query else len(own), step):
                    asked, some = (slice(k, k + step), slice(None)) if by_query else (slice(None), slice(k, k + step))
                    scores = _scores(metric, matrix[asked], v[some])
                    q, r = np.nonzero(chosen(np.where(np.isnan(scores), -np.inf, scores), ids[asked], own[some]) & ~np.isnan(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked][q]), pa.array(own[some][r]), pa.array(scores[q, r])], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(compare, "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    return out.withColumn("score", F.round("score", DIGITS))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """For each query the k most similar other vectors, by score (rounded) and then id.

    Each batch of rows keeps what may be among the k best of a query before anything is shuffled.
    Vectors that are null, empty or hold nulls are left out, as are scores that are not numbers.
    """

    def chosen(scores, ids, own):
        scores = np.where(ids[:, None] == own[None, :], -np.inf, scores)
        least = np.partition(scores, max(scores.shape[1] - k, 0), axis=1)[:, max(scores.shape[1] - k, 0)]
        # What rounds to the same score is ranked by id, so near ties stay.
        return (scores >= least[:, None] - 2 * 10.0**-DIGITS) & np.isfinite(scores)

    scored = _compared(vectors, queries, metric, chosen, True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def pairwise(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """Similarities of all pairs, i < j: a matrix, so its size is the square of the table's."""
    pairs = _compared(vectors, vectors, metric, lambda scores, ids, own: np.broadcast_to(ids[:, None] < own[None, :], scores.shape))
    return pairs.select(F.col("query_id").alias("left_id"), F.col("vec_id").alias("right_id"), "score")


def best_reference(vectors: DataFrame, references: DataFrame, metric: str = "cosine") -> DataFrame:
    """For each vector its most similar reference and what the score means; ties go to the smaller id."""

    def chosen(scores, ids, own):
        return scores >= scores.max(axis=0, keepdims=True) - 2 * 10.0**-DIGITS

    scored = _compared(vectors, references, metric, chosen)
    best = scored.groupBy("vec_id").agg(F.max_by(F.struct("query_id", "score"), F.struct("score", -F.col("query_id"))).alias("b"))
    score = F.col("b.score")
    meaning = F.when(score >= 0.9, "highly similar").when(score >= 0.8, "similar").when(score >= 0.6, "somewhat similar").when(score >= 0.3, "different").otherwise("very different")
    return best.select("vec_id", F.col("b.query_id").alias("reference_id"), score.alias("score"), meaning.alias("meaning"))
