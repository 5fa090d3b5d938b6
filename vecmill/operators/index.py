"""LSH index tables over any family of hash functions, and their persistence as Parquet with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from vecmill.operators.cross_polytope import CrossPolytopeHash
from vecmill.operators.simhash import SimHash
from vecmill.sources.vectors import VectorTable


class IndexMismatch(ValueError):
    """The stored index belongs to other data or hashers."""


class HashFamily(Protocol):
    """What an index needs of hash functions: ``reps`` hashes of ``bits`` functions each, of ``unit`` bits, packed with
    the first function highest; the metrics they are for; and the chance that one function agrees at a distance."""

    bits: int
    reps: int
    unit: int
    metrics: tuple[str, ...]

    def hash(self, df: DataFrame) -> DataFrame: ...

    def collision_probability(self, distance: Column) -> Column: ...

    def probability(self, distance: np.ndarray) -> np.ndarray: ...

    def spec(self) -> dict: ...

    def fingerprint(self) -> str: ...


#: How a family is made again from its ``spec``; other families can be added.
FAMILIES: dict[str, Callable[..., HashFamily]] = {"simhash": SimHash, "cross-polytope": CrossPolytopeHash}


@dataclass(frozen=True)
class LshIndex:
    """``df`` has rep, hash and vec_id."""

    data: VectorTable
    hasher: HashFamily
    df: DataFrame

    @staticmethod
    def build(data: VectorTable, hasher: HashFamily) -> "LshIndex":
        if data.metric not in hasher.metrics:
            raise ValueError(f"these hashes are for the metrics {hasher.metrics}, not {data.metric}")
        return LshIndex(data, hasher, hasher.hash(data.df))

    def manifest(self) -> dict:
        return {"data": self.data.fingerprint(), "hasher": self.hasher.fingerprint(), "spec": self.hasher.spec()}

    def save(self, path: str) -> None:
        """Sorted by hash within each repetition, so that readers skip row groups. The manifest is written last:
        a folder without one is not an index."""
        ordered = self.df.repartitionByRange("rep", "hash").sortWithinPartitions("rep", "hash", "vec_id")
        ordered.write.mode("overwrite").partitionBy("rep").parquet(f"{path}/table")
        spark = self.df.sparkSession
        spark.createDataFrame([(json.dumps(self.manifest()),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, data: VectorTable) -> "LshIndex":
        stored = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if stored["data"] != data.fingerprint():
            raise IndexMismatch("the index was built over other data")
        spec = dict(stored["spec"])
        hasher = FAMILIES[spec.pop("family")](**spec)
        if stored["hasher"] != hasher.fingerprint():
            raise IndexMismatch("the index was built with other hashers")
        return LshIndex(data, hasher, spark.read.parquet(f"{path}/table").select("rep", "hash", "vec_id"))

    @staticmethod
    def build_cached(spark: SparkSession, data: VectorTable, hasher: HashFamily, folder: str) -> "LshIndex":
        """Reads the index from ``folder`` if one of this data and hasher is there, else builds and writes it."""
        path = f"{folder}/{data.fingerprint()}-{hasher.fingerprint()}"
        try:
            return LshIndex.load(spark, path, data)
        except IndexMismatch:
            raise
        except Exception as e:  # Spark raises several kinds for a missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
        LshIndex.build(data, hasher).save(path)
        return LshIndex.load(spark, path, data)

    def same(self, other: "LshIndex") -> bool:
        if self.hasher.fingerprint() != other.hasher.fingerprint():
            return False
        a, b = self.df.select("rep", "hash", "vec_id"), other.df.select("rep", "hash", "vec_id")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
