"""Connected components of an edge table, in few rounds, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v: bigint); label is the smallest node that can be reached.

    Each round takes over the smallest parent among the neighbours' parents, for a node and for its parent, and then
    the parent's parent; the number of rounds grows with the logarithm of the longest path, and they go on until no label
    changes. Each round reads and writes tables, so that hot nodes can be split in joins and a lost executor costs one
    round at most; the tables of the round before are deleted.
    """
    edges = edges.filter("u <> v").select("u", "v").distinct()
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v").distinct(), "components-edges")
    state = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "components-labels")
    total = None
    while True:
        now = state.agg(F.sum(F.col("label").cast("decimal(38,0)"))).head()[0]
        if now == total:
            break
        total = now
        seen = both.join(state.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        found = state.join(seen.withColumnRenamed("u", "node"), "node")
        offers = found.select("node", F.least("label", "m").alias("label")).union(found.select("label", F.least("label", "m")))
        offered = materialize(offers.groupBy("node").agg(F.min("label").alias("label")), "components-labels")
        up = offered.select(F.col("node").alias("label"), F.col("label").alias("above"))
        old, state = state, materialize(offered.join(up, "label").select("node", F.col("above").alias("label")), "components-labels")
        discard(old, offered)
    discard(both)
    return state
