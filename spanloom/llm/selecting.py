"""Keep or drop rows of a wide table by a list of keys, without shuffling the wide table if possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, about 100 bytes each as numbers; a longer list is joined by shuffling.
BROADCAST_KEYS = 2_000_000


def keep(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(docs, keys, key, "left_semi")


def drop(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return _select(docs, keys, key, "left_anti")


def _select(docs: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``keys`` must be a written table: it is counted first."""
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, key, how)
