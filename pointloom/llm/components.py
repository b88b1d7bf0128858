"""Connected components over an edge table of any size, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _towards_smallest(edges: DataFrame, both: bool) -> DataFrame:
    """Star step: link the larger (``both``) or all smaller neighbours of a node to its smallest neighbour."""
    if both:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ways = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = ways.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (u, v), the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014) turn each component into a
    star; each round is written to the shared folder, so that a lost executor costs one round.
    """
    state = None
    while True:  # every round but the last shortens a path, so it ends
        edges = written(_towards_smallest(_towards_smallest(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)
