"""Connected components of links between 64-bit ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a long, b long): root is the smallest id it is linked to, itself included.

    Each round is two joins on pre-aggregated minima and one small table in the shared folder; rounds grow with the
    logarithm of the longest chain. Nothing is collected but a count and a checksum. No links: an empty result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, last = written(links, "links"), None
    for _ in range(MOST_ROUNDS):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))
        last = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
