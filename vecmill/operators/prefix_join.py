"""Joins of queries and rows by hash prefix, and pairs within buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vecmill.functions import bits as B

KEYS = 64


def query_hashes(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, rep, qhash)"""
    return index.join(queries.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "rep", F.col("hash").alias("qhash"))


def shared(a: Column, b: Column, functions: int, unit: int = 1) -> Column:
    """Leading functions, of ``unit`` bits each, on which two hashes agree."""
    return F.floor(B.lcp(a, b, functions * unit) / unit).cast("int")


def collisions(index: DataFrame, hashed: DataFrame, prefix: int, bits: int, below: int | None = None, unit: int = 1, hashes: bool = False) -> DataFrame:
    """(qid, vec_id, rep, lcp) of rows that share the ``prefix`` leading of ``bits`` functions with the query in a
    repetition, and fewer than ``below`` if given, with both hashes if asked: an equi-join on (rep, prefix). Short prefixes have few keys that hold
    many rows each, so rows and queries are spread over KEYS keys or more."""
    spread = F.lit(-(-KEYS >> min(prefix * unit, 30)) or 1).cast("long")
    a = hashed.withColumn("key", B.prefix_key(F.col("qhash"), prefix * unit, bits * unit)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
    b = index.select("rep", "hash", "vec_id", B.prefix_key(F.col("hash"), prefix * unit, bits * unit).alias("key"), F.pmod(F.xxhash64("vec_id"), spread).alias("part"))
    met = b.join(a, ["rep", "key", "part"]).select("qid", "vec_id", "rep", *(["hash", "qhash"] if hashes else []), shared(F.col("hash"), F.col("qhash"), bits, unit).alias("lcp"))
    return met if below is None else met.where(F.col("lcp") < below)


def bucket_pairs(index: DataFrame, prefix: int, bits: int) -> DataFrame:
    """(rep, a, b): pairs of one bucket, a < b. This operator's result is the pairs themselves; a longer prefix
    keeps the buckets small."""
    keyed = index.select("rep", "vec_id", B.prefix_key(F.col("hash"), prefix, bits).alias("key"))
    a, b = keyed.withColumnRenamed("vec_id", "a"), keyed.withColumnRenamed("vec_id", "b")
    return a.join(b, ["rep", "key"]).where("a < b").select("rep", "a", "b")


def nested_pairs(index: DataFrame, hashed: DataFrame, prefix: int, bits: int) -> DataFrame:
    """(qid, rep, a, b): pairs within the query's bucket at ``prefix`` that are not both in the one a bit longer."""
    near = collisions(index, hashed, prefix, bits)
    a = near.select("qid", "rep", F.col("vec_id").alias("a"), F.col("lcp").alias("la"))
    b = near.select("qid", "rep", F.col("vec_id").alias("b"), F.col("lcp").alias("lb"))
    return a.join(b, ["qid", "rep"]).where((F.col("a") < F.col("b")) & (F.least("la", "lb") == prefix)).select("qid", "rep", "a", "b")


def cross_pairs(index: DataFrame, hashed: DataFrame, prefix: int, bits: int) -> DataFrame:
    """(qid, rep, a, b): a in the query's bucket one bit longer than ``prefix``, b only in that of ``prefix``."""
    near = collisions(index, hashed, prefix, bits)
    a = near.where(F.col("lcp") > prefix).select("qid", "rep", F.col("vec_id").alias("a"))
    b = near.where(F.col("lcp") == prefix).select("qid", "rep", F.col("vec_id").alias("b"))
    return a.join(b, ["qid", "rep"]).select("qid", "rep", "a", "b")
