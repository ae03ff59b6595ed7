"""Connected components of a graph given as a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, written


def connected_components(links: DataFrame) -> DataFrame:
    """``id, root`` for each node of ``links`` (``a, b`` long, never null): root is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows one more pointer, and contracts the links; all
    tables are written to the shared folder between rounds, and the links that are left shrink by a constant factor
    at least. Nothing is gathered on the driver but whether links are left.
    """
    spark = links.sparkSession
    links = written(links.filter("a <> b").distinct(), "links")
    nodes = written(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("root", F.col("id")), "nodes")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        near = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m")), "near")
        hop = near.select(F.col("x").alias("m"), F.col("m").alias("next"))
        to = near.join(hop, "m").select("x", F.least("m", "next").alias("y"))
        to = written(to, "pointers")
        new_links = links.join(to.select(F.col("x").alias("a"), F.col("y").alias("ra")), "a").join(to.select(F.col("x").alias("b"), F.col("y").alias("rb")), "b")
        new_links = written(new_links.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        new_nodes = written(nodes.join(to.select(F.col("x").alias("root"), "y"), "root", "left").select("id", F.coalesce("y", "root").alias("root")), "nodes")
        for old in (links, nodes, near, to):
            release(spark, old)
        links, nodes = new_links, new_nodes
    return nodes
