"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import written


def _pairs(df: DataFrame, u, v) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(_pairs(edges, "v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return _pairs(joined.where("v <> m"), "v", "m").union(_pairs(least, "u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) in any order, repeats allowed -> (node, component), the least node of each component.

    Alternates the two star steps until the edges stay as they are, each round a written
    table. A node in no edge, or only in an edge to itself, is not listed. Nothing but a
    count and a check sum comes to the driver.
    """
    now = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
