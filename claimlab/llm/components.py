"""Connected components of a table of links, by alternating star contraction.

Each round lets every node hang its larger neighbours, then its smaller ones, onto its
smallest neighbour; the links become stars around each component's smallest node in a
number of rounds that grows with the logarithm of the component's size.  Every round is
two partial aggregations and two joins over the links, written into the shared folder;
no links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(links: DataFrame) -> bool:
    """Whether every larger node has one link and no centre hangs on another."""
    doubled = links.groupBy("hi").count().where("count > 1").limit(1).count()
    return not doubled and not links.join(links.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link and is not its component's smallest.

    ``links`` may hold repeats, loops, nulls (ignored) and either direction.
    """
    pairs = links.where(F.col(a) != F.col(b))
    links = materialise(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    while not _stars(links):
        both = links.union(links.select("lo", "hi")).toDF("node", "other")
        # Written, so that both sides of the joins are plain exchanges: Spark can then split
        # a hub's links over tasks.
        least = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "least")
        large = materialise(both.where("other > node").join(least.hint("merge"), "node").select(F.col("other").alias("hi"), F.col("root").alias("lo")).distinct(), "large")
        nearest = materialise(large.groupBy("hi").agg(F.min("lo").alias("root")), "nearest")
        small = large.join(nearest.hint("merge"), "hi").select(F.inline(F.array(F.struct("hi", F.col("root").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")))))
        done, links = links, materialise(small.where("hi != lo").distinct(), "links")
        discard(done, least, large, nearest)
    return links.toDF("node", "root")
