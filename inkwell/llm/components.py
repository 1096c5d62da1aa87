"""Connected components of an edge table, without collecting anything to the driver.

Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges stop changing: then every node
hangs on the smallest node of its component.  Each step is a grouped minimum with map-side combination and a join that
adaptive execution can split where a node is hot; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with v < u.  Large: all larger neighbours of a node go to the node's smallest neighbour; small: the node and its smaller neighbours do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # The minimum is a table of its own, so the join below has plain exchanges on both sides, which can be split.
    low = written(low, "cc-min")
    near = both.join(low, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("x")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u that isn't the smallest, v, of its component.  ``edges``: (u, v) of a sortable type."""
    with scratch(edges.sparkSession) as keep:
        now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"), "cc")
        sums = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
        before = now.agg(*sums).head()
        while before["n"]:
            now = written(_star(written(_star(now, True), "cc-large"), False), "cc")
            after = now.agg(*sums).head()
            if after == before:
                break
            before = after
        return keep(now)
