"""Connected components over an edge table by alternating star joins.

Large-star: every neighbour above u points to the smallest of u and its
neighbours. Small-star: every neighbour at or below u does. Repeated until the
edges no longer change, each node points at the smallest of its component. The
smallest neighbour is an aggregate (partial before the shuffle), so a node with
a third of all edges is never gathered. It is stored before the join back: then
that is a join of plain tables, in which AQE's skew split deals such a node out.
Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (hi, lo) with hi > lo."""
    near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m"))
    low = stored(low.select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "lows")
    joined = near.join(low, F.col("u") == F.col("w"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(low.select(F.col("w").alias("hi"), F.col("m").alias("lo")))
    return out.filter("hi > lo").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of an edge and the smallest node of its component.

    `edges` has two long columns hi, lo with hi > lo. Nodes without an edge
    are not in the result.
    """
    now = stored(edges.select("hi", "lo").distinct(), "edges")
    state = _state(now)
    while True:
        now = stored(_star(_star(now, True), False), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    lows = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(lows)
