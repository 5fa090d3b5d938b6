"""The unnormalized Walsh-Hadamard transform."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SMALL = 64


def check_length(n: int) -> None:
    if n < 1 or n & (n - 1) or n > 1 << 30:
        raise ValueError(f"the length must be a power of two up to 2^30, not {n}")


@lru_cache(maxsize=32)
def sign_matrix(n: int, kind: str = "d") -> np.ndarray:
    out = np.ones((1, 1), dtype=kind)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def butterfly(x: np.ndarray, radix: int = 5) -> np.ndarray:
    """Transforms the last axis, whole batches at a time: ``radix`` levels of the butterfly are one product with a
    small sign matrix, so the work is n log n and each pass over the data does several levels. Single precision stays
    single, all else is double."""
    n = x.shape[-1]
    check_length(n)
    kind = np.float32 if x.dtype == np.float32 else np.float64
    out, h, left = x.astype(kind, copy=n == 1).reshape(-1, n), 1, n.bit_length() - 1
    while left:
        m = 1 << min(radix, left)
        signs = sign_matrix(m, out.dtype.char)
        out = out.reshape(-1, m) @ signs if h == 1 else signs @ out.reshape(-1, m, h)
        h, left = h * m, left - min(radix, left)
    return out.reshape(x.shape)


def hadamard(v: Column, n: int) -> Column:
    """The transform as an expression, in n^2: for vectors of up to SMALL parts."""
    check_length(n)
    sign = lambda i, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, 1.0).otherwise(-1.0)
    part = lambda i: F.aggregate(F.zip_with(v, F.sequence(F.lit(0), F.lit(n - 1)), lambda x, j: x * sign(i, j)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part)


def transform(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the transform of ``column`` in its place, by batches."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch[column] = list(butterfly(np.stack(batch[column].to_numpy())))
            yield batch

    return df.mapInPandas(task, df.schema)


def register(spark: SparkSession) -> None:
    """Makes ``fht``, ``dot``, ``angular_distance`` and ``lcp32`` callable from SQL."""

    @F.pandas_udf("array<double>")
    def fht(v: pd.Series) -> pd.Series:
        return pd.Series([butterfly(np.asarray(x, dtype=np.float64)) for x in v])

    spark.udf.register("fht", fht)
    for name, signature, body in (
        ("dot", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
        ("angular_distance", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
        ("lcp32", "a BIGINT, b BIGINT) RETURNS INT", "CASE WHEN a = b THEN 32 ELSE 32 - length(bin(a ^ b)) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature} RETURN {body}")
