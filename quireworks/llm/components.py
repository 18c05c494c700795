"""Connected components over a table of links, by alternating large and small stars; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import discard, materialised

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links(u, v); nodes without links are not listed.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    at = materialised(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        before, at = at, materialised(_small_star(_large_star(at)), "links")
        discard(before)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return at.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
