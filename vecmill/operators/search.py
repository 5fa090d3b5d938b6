"""Adaptive (k, delta) search over an LSH index.

Tables are visited from long prefixes to short ones, repetition by repetition, until the chance that a true
neighbour was missed falls below delta. With lcp the leading functions that query and row share in a repetition,
step = (bits - lcp) * reps + rep numbers the visits; a query stops at the first step at which its k-th distance
so far makes the failure chance small enough. Rounds over a falling prefix schedule join only what is new, test
all steps the round covers, and drop the queries that stopped.

What a query carries from round to round is bounded: the k nearest rows of each step and a count per step. The last
round, in which the prefix is empty and every row is visited, joins no tables: the queries that are left are compared with
all rows in blocks, as in exact search, each row with its hashes of all repetitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vecmill.functions import vectors as V
from vecmill.operators.exact import crossed
from vecmill.operators.index import HashFamily, LshIndex
from vecmill.operators.prefix_join import collisions, query_hashes, shared
from vecmill.sources.durable import cut

RESULT = "qid long, rank int, vec_id long, d double, stop_prefix int, stop_rep int, collisions long"
NEAR = ["qid", "step", "vec_id", "d"]


def schedule(bits: int) -> list[int]:
    return [p for p in dict.fromkeys((bits, bits * 3 // 4, bits // 2, bits // 4, bits // 8, 0))]


def stop_step(first: np.ndarray, d: np.ndarray, k: int, delta: float, family: HashFamily, limit: int) -> int | None:
    """The step at which a query stops, if that is ``limit`` or before. ``first`` ascends."""
    bits, reps = family.bits, family.reps
    steps = np.arange(limit + 1)
    kth, top, at = np.full(limit + 1, np.nan), [], 0
    for s in np.unique(first[first <= limit]):
        while at < len(first) and first[at] == s:
            top.append(d[at])
            at += 1
        top = sorted(top)[:k]
        if len(top) == k:
            kth[s:] = top[-1]
    p = family.probability(kth)
    prefix, rep = bits - steps // reps, steps % reps + 1
    longer = np.where(prefix < bits, (1 - p ** (prefix + 1)) ** (reps - rep), 1.0)
    fails = (1 - p**prefix) ** rep * longer
    hit = np.flatnonzero(fails < delta)
    return int(hit[0]) if len(hit) else None


def stopper(k: int, delta: float, family: HashFamily, limit: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Turns what a query carries into its answer if it stops within ``limit`` steps, else into no rows."""

    def stop(batch: pd.DataFrame) -> pd.DataFrame:
        near = batch[batch["vec_id"].notna()]
        # A row that was found again counts where it came first.
        one = near.groupby("vec_id").agg({"step": "min", "d": "min"}).reset_index().sort_values(["step", "vec_id"])
        at = stop_step(one["step"].to_numpy(dtype=np.int64), one["d"].to_numpy(), k, delta, family, limit)
        if at is None and last:
            at = limit
        if at is None:
            return pd.DataFrame(columns=["qid", "rank", "vec_id", "d", "stop_prefix", "stop_rep", "collisions"])
        best = one[one["step"] <= at].sort_values(["d", "vec_id"]).head(k)
        visits = int(batch.loc[batch["step"] <= at, "visits"].sum())
        return pd.DataFrame({"qid": batch["qid"].iloc[0], "rank": np.arange(1, len(best) + 1), "vec_id": best["vec_id"], "d": best["d"], "stop_prefix": family.bits - at // family.reps, "stop_rep": at % family.reps + 1, "collisions": visits})

    return stop


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query and step of ``found`` (NEAR): tasks keep no more before they shuffle."""
    w = Window.partitionBy("qid", "step").orderBy("d", "vec_id")
    return found.select(*NEAR).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def carried(near: DataFrame, visits: DataFrame) -> DataFrame:
    """(qid, step, vec_id, d, visits): near rows, and counts without a row."""
    return near.withColumn("visits", F.lit(0).cast("long")).unionByName(visits, allowMissingColumns=True)


def by_tables(table: DataFrame, todo: DataFrame, rows: DataFrame, q: DataFrame, family: HashFamily, prefix: int, above: int) -> tuple[DataFrame, DataFrame]:
    """(near, visits) of the rows that share ``prefix`` functions or more, but fewer than ``above``, with a query."""
    bits, reps = family.bits, family.reps
    new = collisions(table, todo, prefix, bits, above, family.unit).withColumn("step", (F.lit(bits) - F.col("lcp")) * reps + F.col("rep"))
    # One row per new (query, row), with its visits; vectors are fetched after that.
    new = cut(new.groupBy("qid", "vec_id").agg(F.collect_list("step").alias("steps")))
    visits = new.select("qid", F.explode("steps").alias("step")).groupBy("qid", "step").agg(F.count("*").alias("visits"))
    near = new.select("qid", "vec_id", F.array_min("steps").alias("step")).join(rows, "vec_id").join(q, "qid")
    return near, visits


def by_rows(table: DataFrame, todo: DataFrame, rows: DataFrame, q: DataFrame, family: HashFamily, above: int) -> tuple[DataFrame, DataFrame]:
    """The same without a prefix: the queries of ``todo`` with all rows."""
    bits, reps = family.bits, family.reps

    def packed(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
        lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rep", column))).alias("x"))
        return lists.select(key, F.transform("x", lambda x: x[column]).alias(name))

    own = packed(table, "vec_id", "hash", "hashes").join(rows, "vec_id")
    asked = packed(todo, "qid", "qhash", "qhashes").join(q, "qid")
    step = lambda a, b: (F.lit(bits) - shared(a, b, bits, family.unit)) * reps
    steps = F.transform(F.zip_with("hashes", "qhashes", step), lambda s, rep: s + rep)
    # Longer shared prefixes were visited in earlier rounds.
    steps = F.filter(steps, lambda s: s > (bits - above) * reps + reps - 1)
    met = crossed(own, asked).withColumn("steps", steps)
    visits = met.select("qid", F.explode("steps").alias("step")).groupBy("qid", "step").agg(F.count("*").alias("visits"))
    return met.where(F.size("steps") > 0).withColumn("step", F.array_min("steps")), visits


def search(index: LshIndex, queries: DataFrame, k: int, delta: float) -> DataFrame:
    """(qid, rank, vec_id, d, stop_prefix, stop_rep, collisions): ascending by (d, vec_id); if there are no k
    rows, all."""
    if k < 1 or not 0 < delta < 1:
        raise ValueError("k must be 1 or more and delta between 0 and 1")
    family = index.hasher
    bits, reps = family.bits, family.reps
    family.probability(np.zeros(1))  # what it needs is computed here, not in every task
    table = cut(index.df)
    todo = cut(query_hashes(table, queries))
    q = queries.select(F.col("vec_id").alias("qid"), F.struct("v", "sqnorm").alias("a"))
    rows = index.data.df.select("vec_id", F.struct("v", "sqnorm").alias("b"))
    state, found, above = None, None, bits + 1
    for prefix in schedule(bits):
        near, visits = by_tables(table, todo, rows, q, family, prefix, above) if prefix else by_rows(table, todo, rows, q, family, above)
        near = nearest(near.withColumn("d", V.rounded(index.data.distance("a", "b"))), k)
        new = carried(near, visits)
        state = cut(new if state is None else state.unionByName(new))
        limit = (bits - prefix) * reps + reps - 1
        done = cut(state.groupBy("qid").applyInPandas(stopper(k, delta, family, limit, prefix == 0), RESULT))
        found = done if found is None else found.unionByName(done)
        ended = done.select("qid").distinct()
        todo, state, above = cut(todo.join(ended, "qid", "left_anti")), state.join(ended, "qid", "left_anti"), prefix
        if todo.isEmpty():
            break
    return found


def collision_threshold(index: LshIndex, r: float, delta: float) -> tuple[float, float]:
    """(p, bound): the chance that a row at similarity r collides in a table, and the share of tables that the count
    threshold asks for."""
    family = index.hasher
    p = float(family.probability(np.array([1.0 - r]))[0]) ** family.bits
    return p, p - math.sqrt(math.log(2 / delta) / (2 * family.reps))


def collision_range(index: LshIndex, queries: DataFrame, r: float, delta: float) -> DataFrame:
    """(qid, vec_id, count, similarity, hit): rows whose collisions pass the count threshold for similarity r;
    vectors are fetched only for them."""
    from vecmill.functions.probability import count_threshold

    bits, reps = index.hasher.bits, index.hasher.reps
    counts = collision_counts(index, queries)
    p = F.pow(index.hasher.collision_probability(F.lit(1.0 - r)), F.lit(bits))
    kept = counts.where(F.col("count") >= count_threshold(p, delta, reps))
    q = queries.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    met = kept.join(index.data.df.select("vec_id", "v"), "vec_id").join(q, "qid")
    sim = V.rounded(V.dot(F.col("v"), F.col("qv")))
    return met.select("qid", "vec_id", "count", sim.alias("similarity")).withColumn("hit", F.col("similarity") >= r)


def collision_counts(index: LshIndex, queries: DataFrame) -> DataFrame:
    """(qid, vec_id, count): in how many tables a row shares the query's whole hash."""
    bits = index.hasher.bits
    return collisions(index.df, query_hashes(index.df, queries), bits, bits, unit=index.hasher.unit).groupBy("qid", "vec_id").agg(F.count("*").alias("count"))
