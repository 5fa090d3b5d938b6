"""Exact search: every query against every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vecmill.functions import vectors as V
from vecmill.sources.vectors import VectorTable

#: Queries up to which they are broadcast, of vectors of some hundred parts; more are joined in blocks of this size.
QUERY_BLOCK = 5_000


def crossed(rows: DataFrame, queries: DataFrame, key: str = "qid") -> DataFrame:
    """Every row with every query (of other column names), the work of exact search. Queries travel in blocks of bounded
    size to the rows."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return rows.join(F.broadcast(queries), F.lit(True))
    blocks = F.lit(-(-n // QUERY_BLOCK)).cast("long")
    queries = queries.withColumn("__block", F.pmod(F.xxhash64(key), blocks))
    rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.join(queries, "__block").drop("__block")


def pairs(table: VectorTable, queries: DataFrame) -> DataFrame:
    """(qid, vec_id, d) of all pairs."""
    q = queries.select(F.col("vec_id").alias("qid"), F.struct("v", "sqnorm").alias("a"))
    joined = crossed(table.df.select("vec_id", F.struct("v", "sqnorm").alias("b")), q)
    return joined.select("qid", "vec_id", V.rounded(table.distance("a", "b")).alias("d"))


def knn(table: VectorTable, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, d): ascending by (d, vec_id); min(k, n) rows a query. Every task keeps k rows a query
    before anything is shuffled."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    w = Window.partitionBy("qid").orderBy("d", "vec_id")
    return pairs(table, queries).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "d")


def within(table: VectorTable, queries: DataFrame, r: float) -> DataFrame:
    """(qid, vec_id, d) with d <= r."""
    return pairs(table, queries).where(F.col("d") <= r)


def largest_product(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, vec_id, product): the row with the largest inner product, ties to the smaller id."""
    q = queries.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    both = crossed(rows, q).select("qid", "vec_id", V.rounded(V.dot(F.col("v"), F.col("qv"))).alias("product"))
    best = F.max(F.struct("product", (-F.col("vec_id")).alias("i")))
    return both.groupBy("qid").agg(best.alias("b")).select("qid", (-F.col("b.i")).alias("vec_id"), F.col("b.product").alias("product"))
