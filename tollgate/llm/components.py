"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node that has a link.

    Each round points every node at its smallest neighbour, follows the pointers
    to their ends by doubling, and replaces links by links between the ends; at
    least half of the nodes with links are gone after it. All of it is joins and
    aggregates with partial results. Each step is a table in the shared folder;
    tables that are no longer needed are deleted. Nothing but the number of
    links comes to the driver. Self-links and repeated links do no harm; an
    empty table gives an empty one.
    """
    spark, old = links.sparkSession, []

    def step(df: DataFrame) -> DataFrame:
        out, path = stored(df, "components")
        old.append(path)
        return out

    edges = step(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    nodes = step(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = step(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        while True:
            up = to.alias("x").join(to.alias("y"), F.col("x.p") == F.col("y.a"))
            to = step(up.select(F.col("x.a").alias("a"), F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved")))
            if to.where("moved").isEmpty():
                break
            to = to.select("a", "p")
        to = to.select(F.col("a").alias("n"), "p")
        nodes = step(nodes.join(to, nodes["root"] == to["n"], "left").select("node", F.coalesce("p", "root").alias("root")))
        edges = edges.join(to, edges["a"] == to["n"]).select(F.col("p").alias("a"), "b")
        edges = edges.join(to, edges["b"] == to["n"]).select("a", F.col("p").alias("b"))
        edges = step(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for path in old[:-2]:
            drop_path(spark, path)
        del old[:-2]
    return nodes
