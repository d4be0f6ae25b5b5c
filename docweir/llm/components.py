"""Connected components by alternating large-star and small-star rounds over stored link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's neighbours (larger ones, or smaller ones and itself) below the smallest of them."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
    hung = both.join(least, "node")
    if large:
        out = hung.filter("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    else:
        out = hung.filter("near <> least").select(F.col("near").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` holds two long columns. Each round stores its links, so that a lost executor reads
    one round again. Rounds grow with the logarithm of the longest path.
    """
    a, b = links.columns
    links = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        links = stored(_star(_star(links, True), False))
        if links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first() == state:
            break
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
