"""Random projections and inner-product estimates from extreme order statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from vecmill.functions.probability import concomitant_scale
from vecmill.operators.simhash import gaussian

#: Queries and rows that meet in a group, about; their estimates are held at a time.
QUERY_BLOCK = 512
ROW_BLOCK = 1024


def projection(dims: int, out: int, seed: int = 7) -> np.ndarray:
    return np.array([[gaussian(f"projection{seed}", j, d) for d in range(dims)] for j in range(out)])


def project(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(vec_id, j, x) in long form, by matrix products of batches."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = np.stack(batch["v"].to_numpy()) @ matrix.T
                yield pd.DataFrame({"vec_id": np.repeat(batch["vec_id"].to_numpy(), len(matrix)), "j": np.tile(np.arange(len(matrix), dtype=np.int32), len(y)), "x": y.ravel()})

    return df.select("vec_id", "v").mapInPandas(task, "vec_id long, j int, x double")


def profile(projected: DataFrame) -> DataFrame:
    """(j, top): the largest value of each projection."""
    return projected.groupBy("j").agg(F.round(F.max("x"), 6).alias("top"))


def extremes(projected: DataFrame, s: int) -> DataFrame:
    """(qid, j, sign) of projected queries: the s projections on which each is largest (+1) and smallest (-1)."""
    own = projected.select(F.col("vec_id").alias("qid"), "j", F.round("x", 6).alias("x"))
    up, down = Window.partitionBy("qid").orderBy(F.desc("x"), "j"), Window.partitionBy("qid").orderBy("x", "j")
    top = own.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)})
    return top.where(F.col("a") <= s).select("qid", "j", F.lit(1.0).alias("sign")).unionByName(top.where(F.col("b") <= s).select("qid", "j", F.lit(-1.0).alias("sign")))


def estimate(rows: DataFrame, queries: DataFrame, matrix: np.ndarray, s: int | None = None) -> DataFrame:
    """(qid, vec_id, estimate): the product of query and row from the row's values at the query's extremes; with
    s None only the largest one. Rows of one id count as one, their values summed, unless s is None.

    Only the queries' projections are shuffled: a row's are made where it meets a block of queries."""
    picked = extremes(project(queries, matrix), s or 1)
    if s is None:
        picked = picked.where("sign > 0")
    blocks, parts = -(-max(queries.count(), 1) // QUERY_BLOCK), -(-max(rows.count(), 1) // ROW_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    picked = picked.withColumn("block", some("qid", blocks)).withColumn("part", every(parts))
    rows = rows.select("vec_id", "v", some("vec_id", parts).alias("part")).withColumn("block", every(blocks))

    def task(rows: pa.Table, picked: pa.Table) -> pa.Table:
        if not rows.num_rows or not picked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        v = pc.list_flatten(rows["v"]).to_numpy().reshape(rows.num_rows, matrix.shape[1])
        x = np.ascontiguousarray((v @ matrix.T).T)
        ids = rows["vec_id"].combine_chunks()
        coded = ids.dictionary_encode(null_encoding="encode")
        if s is not None and len(coded.dictionary) < len(ids):
            ids, which, own = coded.dictionary, coded.indices.to_numpy(), x
            x = np.zeros((len(own), len(ids)))
            np.add.at(x.T, which, own.T)
        qids, q = np.unique(picked["qid"].to_numpy(), return_inverse=True)
        total = np.zeros((len(qids), len(ids)))
        for i, j, sign in zip(q, picked["j"].to_numpy(), picked["sign"].to_numpy(), strict=True):
            total[i] += sign * x[j]
        every_id = pa.array(np.tile(np.arange(len(ids)), len(qids)))
        return pa.table({"qid": np.repeat(qids, len(ids)), "vec_id": ids.take(every_id), "total": total.ravel()})

    met = rows.groupBy("block", "part").cogroup(picked.groupBy("block", "part")).applyInArrow(task, "qid long, vec_id long, total double")
    scale = concomitant_scale(len(matrix)) * (1 if s is None else 2 * s)
    return met.select("qid", "vec_id", (F.round(F.col("total") / scale, 6) + F.lit(0.0)).alias("estimate"))


def expected_concomitant(product, norm, dims: int):
    """(expectation, variance) of a row's value at the query's largest projection, as columns."""
    scale = concomitant_scale(dims)
    return product * scale, (norm - product * product) / (scale * scale)
