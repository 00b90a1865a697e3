"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import saved

#: Turns after which something must be wrong, for their number grows with the logarithm of the links.
MAX_TURNS = 60


def _contracted(edges: DataFrame) -> DataFrame:
    """A round, as a stored table: larger neighbours of a node hang on its smallest, then smaller ones and the node do.

    What is used twice is stored, so a plan has a handful of shuffles and not the product of all rounds.
    """
    ways = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("far")), F.struct(F.col("y").alias("node"), F.col("x").alias("far"))))
    low = edges.select(ways.alias("way")).groupBy(F.col("way.node").alias("node")).agg(F.min("way.far").alias("low"))
    large = saved(edges.join(low, edges["y"] == low["node"]).select("x", F.least("y", "low").alias("y")).filter("x <> y").distinct())
    least = large.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low"))
    # A node hangs on its smallest neighbour and so do its other neighbours; the smallest itself is no link.
    hung = large.join(least, large["x"] == least["node"]).select(F.when(F.col("y") == F.col("low"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("low").alias("y"))
    return saved(hung.distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node that can be reached.

    Each turn is a round of star contraction, which writes the links; it ends when a turn changes nothing.  A
    node with many links is reduced to one row per task by each minimum; the join that hands the minimum back is
    one that Spark splits.  Nothing but a count and a sum reaches the driver.
    """
    edges = saved(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y").distinct())
    before = None
    for _ in range(MAX_TURNS):
        edges = _contracted(edges)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the links do not come to rest")
    # Now every link leads to its root.
    return edges.select(F.explode(F.array("x", "y")).alias("node"), F.col("y").alias("root")).distinct()
