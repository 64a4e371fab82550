"""Connected components of a link table, by rounds of star contraction on stored tables.

Each round joins every node's larger neighbours, then its smaller ones, to the least node it knows. A hub's least
neighbour is found with partial aggregation, and the join back has one row for each node on one side, which adaptive
execution can split. The links of a round are written to the scratch folder, so lineage stays short and a lost
executor costs no more than one round. Only two sums for each round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger node u to the smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of the links (u, v) but the least ones themselves."""
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    seen = None
    while True:
        old, links = links, stored(_small_star(_large_star(links).distinct()), "links")
        discard(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.scratch = links.scratch
            return out
        seen = state
