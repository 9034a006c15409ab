"""Connected components of an edge table by alternating large-star and small-star rounds.

Only minima and joins: minima are taken before the shuffle; where there are more than ``MANY`` edges (up to so many a
task can take), a hub's edges stay where they are and the hub is sent to them; nothing but two numbers a round reaches
the driver, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.hot import join_hot
from voxelspark.llm.storage import cut


#: Edges up to which one node may hold them all.
MANY = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))


def _with_lowest(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    return join_hot(edges, low, ["u"], "degree", n) if n > MANY else edges.join(low.drop("degree"), "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(u long, v long)``."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        # each node hands its larger neighbours its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("m", F.least("u", "m"))
        large = _with_lowest(both, low, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large) if state[0] > MANY else large
        # then hands its smaller neighbours, and itself, the smallest of them
        small = _with_lowest(large, _lowest(large), state[0])
        edges = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges, before = cut(edges), state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
