"""Recall and throughput."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

SLACK = 1e-6


def recall_by_ids(truth: DataFrame, answer: DataFrame) -> DataFrame:
    """(qid, recall): the share of the true ids that were answered."""
    hit = answer.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1.0))
    met = truth.join(hit, ["qid", "vec_id"], "left")
    return met.groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def recall_by_distance(truth: DataFrame, answer: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of k answers no farther than the true k-th distance."""
    kth = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.max("d").alias("kth"))
    met = kth.join(answer.select("qid", "d"), "qid", "left")
    ok = F.coalesce((F.col("d") <= F.col("kth") + SLACK).cast("double"), F.lit(0.0))
    return met.groupBy("qid").agg(F.round(F.sum(ok) / k, 6).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n_queries"))


def range_statistics(found: DataFrame, counts: DataFrame, total: int, probability: float, bound: float) -> DataFrame:
    """(qid, total, visited, true_positives, false_positives, at_least_one_collision, threshold_probability,
    threshold_probability_bound): the last two are the chance that a point at the range collides in a table, and the
    share of tables that the count threshold asks for, which allows for the deviation of so many tables."""
    one = counts.groupBy("qid").agg(F.count("*").alias("at_least_one_collision"))
    got = found.groupBy("qid").agg(F.count("*").alias("visited"), F.count_if("hit").alias("true_positives"), F.count_if(~F.col("hit")).alias("false_positives"))
    zero = {c: 0 for c in ("visited", "true_positives", "false_positives")}
    out = one.join(got, "qid", "left").fillna(zero).withColumn("total", F.lit(total).cast("long"))
    return out.withColumns({"threshold_probability": F.lit(round(probability, 6)), "threshold_probability_bound": F.lit(round(bound, 6))})


def by_recall(recalls: DataFrame) -> DataFrame:
    """(place, qid, recall): the worst answered queries first, with their places from 1. Queries are few and take part in
    one order, so one task numbers them."""
    order = Window.orderBy("recall", "qid")
    return recalls.select(F.row_number().over(order).alias("place"), "qid", "recall")


def throughput(run: Callable[[], DataFrame], n_queries: int) -> tuple[float, float]:
    """(seconds, queries a second) of a search whose rows are all made."""
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    return seconds, n_queries / seconds
