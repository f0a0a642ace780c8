"""Connected components of a table of links, on DataFrame operations: alternating large-star and small-star.

Links stay distributed; only the number of rows and a checksum of each round come to the driver. The links of a
hub are handled as rows, with a minimum per node that is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import staged


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a != b")


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of these."""
    down = e.select(F.col("b").alias("n"), F.col("a").alias("s"))  # a < b
    low = down.groupBy("n").agg(F.min("s").alias("m"))
    handed = down.join(low, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).where("a != b")
    return handed.unionAll(low.select(F.col("m").alias("a"), F.col("n").alias("b")))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node that has a link; links: columns a and b, long."""
    e = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    e = staged(e, "links")
    mark = None
    for _ in range(rounds):
        e = staged(_small_star(_large_star(e)).distinct(), "links")
        # b in one row each, and no a that is also a b: every component is a star about its smallest node
        now = e.agg(F.count("*"), F.countDistinct("b"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
