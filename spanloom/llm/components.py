"""Connected components by repeated contraction of the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import Workspace


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; ``component`` is its smallest reachable node.

    Each round sends every node to its smallest neighbour and rewrites the edges to those, so a star
    ends after one round and a path of shuffled names, such as hashes, after logarithmically many; a path
    whose names ascend loses one edge a round.  Aggregates combine before the
    shuffle, so the centre of a large star is no hot key.  Null ends and loops are ignored.  Tables
    of each round are written to the shared folder; nothing of them passes through the driver.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = one.union(one.select("b", "a")).distinct()
    left = work.save(both, "edges")
    hops = []
    while not left.isEmpty():
        hop = work.save(left.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "hops")
        hops.append(hop)
        to_b = hop.select(F.col("a").alias("b"), F.col("m").alias("y"))
        step = left.join(hop, "a").select(F.col("m").alias("x"), "b")
        step = step.join(to_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        after = work.save(step, "edges")
        work.drop(left)
        left = after
    if not hops:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hops[0].select(F.col("a").alias("node"), F.col("m").alias("component"))
    for hop in hops[1:]:
        step = hop.select(F.col("a").alias("component"), "m")
        out = out.join(step, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return work.save(out, "components")
