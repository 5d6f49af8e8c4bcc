"""Connected components by alternating star contraction, in Spark joins and aggregates.

Each round points every node at the least node it can see: first all larger neighbours of a node at its minimum (large
star), then the node and its smaller neighbours (small star). Edges never grow beyond the nodes and edges given, and the
rounds grow with the logarithm of the component size. Minima are partial aggregates, and edges meet them in a join with a
unique side, so a hub with a third of all edges is split by the planner's skew handling and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges(a, b)``.

    The result reads a table that belongs to ``scratch`` from then on. Loops, repeated and reversed edges change nothing; edges with a null end are ignored; no edges give no rows.
    """
    caller, scratch = scratch, Scratch(scratch.spark)
    a, b = F.col("a"), F.col("b")
    stars = scratch.keep(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                         "edges")
    before = _state(stars)
    while before[0]:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        large = scratch.keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars = scratch.keep(small, "small-star")
        after = _state(stars)
        scratch.drop(keep_last=1)
        if after == before:
            break
        before = after
    caller.paths += scratch.paths
    centres = stars.select(F.col("v").alias("node")).distinct()
    return (stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(centres.select("node", F.col("node").alias("component"))))


def _state(stars: DataFrame) -> tuple:
    """Count and order-free checksum of the edges, to see when a round changes nothing."""
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
