"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from vecmill.llm.common import stored


def components(links: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, root) of each linked id, root being the smallest id reachable. ``links`` has long columns a and b.

    Each round hangs the neighbours of every id on its smallest neighbour; rounds grow with the logarithm of a
    component's size. ``store`` writes every round to the shared folder. Stars, which copies make, need two rounds.

    Defined results: rows with a null end and links of an id with itself count for nothing; repeated links count once;
    an empty table gives no rows; other columns are dropped.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
