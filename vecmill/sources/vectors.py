"""Vector tables: readers, in-memory sources, metric preparation and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecmill.functions import vectors as V

#: Bytes of an HDF5 file's rows that a task reads at a time.
HDF5_BYTES = 16 << 20

ANGULAR, EUCLIDEAN = "angular", "euclidean"


@dataclass(frozen=True)
class Metric:
    """How vectors are stored and compared. ``prepare`` turns a vector into the stored one; ``distance`` takes two stored
    vectors and their squared norms. Both are column expressions, so any search over a table takes any metric."""

    name: str
    prepare: Callable[[Column], Column]
    distance: Callable[[Column, Column, Column, Column], Column]


METRICS = {
    ANGULAR: Metric(ANGULAR, V.normalized, lambda a, b, aa, bb: V.angular_distance(a, b)),
    EUCLIDEAN: Metric(EUCLIDEAN, lambda v: v, V.squared_euclidean),
}


@dataclass(frozen=True)
class VectorTable:
    """``df`` has vec_id, v (array<double>) and sqnorm; for the angular metric v is scaled to norm 1. ``metric`` is the
    name of ``form``, which is one of METRICS or the caller's own.

    Rows that cannot be compared (null, zero or non-finite vectors) take no part; ``dropped`` counts them.
    """

    df: DataFrame
    metric: str
    source: DataFrame
    form: Metric

    @staticmethod
    def of(df: DataFrame, metric: str | Metric = ANGULAR, id_col: str = "vec_id", vector_col: str = "embedding") -> "VectorTable":
        if not isinstance(metric, Metric) and metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        form = metric if isinstance(metric, Metric) else METRICS[metric]
        rows = df.select(F.col(id_col).alias("vec_id"), V.doubles(F.col(vector_col)).alias("v"))
        kept = rows.where(V.usable(F.col("v")))
        kept = kept.withColumn("v", form.prepare(F.col("v")))
        return VectorTable(kept.withColumn("sqnorm", V.squared_norm(F.col("v"))), form.name, rows, form)

    @staticmethod
    def read(spark: SparkSession, path: str, metric: str | Metric = ANGULAR, **names: str) -> "VectorTable":
        return VectorTable.of(spark.read.parquet(path), metric, **names)

    @staticmethod
    def from_arrays(spark: SparkSession, arrays: Iterable[Iterable[float]], metric: str | Metric = ANGULAR) -> "VectorTable":
        rows = [(i, [float(x) for x in a]) for i, a in enumerate(arrays)]
        return VectorTable.of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), metric)

    def dropped(self) -> int:
        return self.source.where(~V.usable(F.col("v"))).count()

    def num_points(self) -> int:
        return self.df.count()

    def num_dimensions(self) -> int:
        row = self.df.select(F.size("v")).first()
        return row[0] if row else 0

    def get(self, vec_id: int) -> DataFrame:
        return self.df.where(F.col("vec_id") == vec_id)

    def distance(self, left: str = "a", right: str = "b") -> Column:
        """Distance of two joined rows under the aliases; squared for the Euclidean metric."""
        return self.form.distance(*[F.col(f"{side}.{c}") for c in ("v", "sqnorm") for side in (left, right)])

    def fingerprint(self) -> str:
        """SHA-256 over the rows, independent of their order, and the metric. Rows are hashed where they stand and
        folded by 256 buckets, so no task sees all of them."""
        return fingerprint_frame(self.df, self.metric).first()[0]


def fingerprint_frame(df: DataFrame, metric: str) -> DataFrame:
    text = F.concat_ws(",", F.transform("v", lambda x: F.format_string("%d", F.round(x * 1000000).cast("long"))))
    rows = df.select(F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), text), 256).alias("h"))
    # Equal buckets of sorted digests: a bucket holds 1/4096 of the rows.
    buckets = rows.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return buckets.agg(F.sha2(F.concat(F.lit(f"{metric}:"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")), 256).alias("fingerprint"))


def read_hdf5(spark: SparkSession, path: str, member: str, metric: str = ANGULAR) -> VectorTable:
    """A 2-D member of an HDF5 file in a folder that all executors see. Tasks read ranges of rows by themselves; the
    driver only asks for the shape. Needs h5py on driver and executors."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 files needs h5py; convert them to Parquet otherwise") from e
    with h5py.File(path) as f:
        n, dims = f[member].shape
    step = max(1, HDF5_BYTES // (8 * max(dims, 1)))

    def task(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        import h5py

        with h5py.File(path) as f:
            for batch in batches:
                for lo in batch["id"]:
                    x = np.asarray(f[member][lo : lo + step], dtype=np.float64)
                    yield pd.DataFrame({"vec_id": np.arange(lo, lo + len(x)), "embedding": list(x)})

    starts = spark.range(0, n, step, numPartitions=max(1, -(-n // step)))
    return VectorTable.of(starts.mapInPandas(task, "vec_id long, embedding array<double>"), metric)


def ground_truth(df: DataFrame, id_col: str = "qid", neighbors: str = "neighbors", distances: str = "distances", k: int | None = None) -> DataFrame:
    """Array columns of true neighbours in long form: qid, rank (from 1), vec_id, dist."""
    pairs = df.select(F.col(id_col).alias("qid"), F.posexplode(F.arrays_zip(F.col(neighbors).alias("i"), F.col(distances).alias("d"))).alias("rank", "x"))
    out = pairs.select("qid", (F.col("rank") + 1).alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.d").alias("dist"))
    return out if k is None else out.where(F.col("rank") <= k)


def read_range_experiment(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of range-query experiments, with a header."""
    schema = "range double, visited long, threshold_probability double, threshold_probability_bound double"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def queries_of(spark: SparkSession, sf_dir: str, metric: str = ANGULAR) -> tuple[VectorTable, DataFrame]:
    """The embeddings and the stated query set: rows whose id is divisible by 100."""
    table = VectorTable.read(spark, f"{sf_dir}/embeddings.parquet", metric)
    return table, table.df.where(F.col("vec_id") % 100 == 0)
