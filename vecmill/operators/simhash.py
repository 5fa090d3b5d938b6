"""SimHash: signs of Gaussian projections, packed most significant bit first."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecmill.functions import probability
from vecmill.sources.vectors import ANGULAR


def gaussian(tag: str, *key: int) -> float:
    """A standard normal number from a digest, so that other engines can rebuild it."""
    digest = hashlib.md5(":".join((tag, *map(str, key))).encode()).hexdigest()
    u = (int(digest[:8], 16) + 1) / 4294967297.0
    w = int(digest[8:16], 16) / 4294967296.0
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * w)


@dataclass(frozen=True)
class SimHash:
    """``reps`` hashes of ``bits`` functions over vectors of ``dims`` parts."""

    dims: int
    bits: int = 32
    reps: int = 1
    seed: int = 1234

    #: Bits of a function, and the metrics whose distances ``probability`` takes.
    unit = 1
    metrics = (ANGULAR,)

    def __post_init__(self) -> None:
        if self.dims < 1 or self.reps < 1 or not 1 <= self.bits <= 32:
            raise ValueError("dims and reps must be 1 or more, bits 1 to 32")

    @cached_property
    def directions(self) -> np.ndarray:
        """(reps, bits, dims)"""
        tag = f"simhash{self.seed}"
        return np.array([[[gaussian(tag, r, f, d) for d in range(self.dims)] for f in range(self.bits)] for r in range(self.reps)])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, f, d.tolist()) for r, fs in enumerate(self.directions) for f, d in enumerate(fs)]
        return spark.createDataFrame(rows, "rep int, func int, dir array<double>")

    def spec(self) -> dict:
        return {"family": "simhash", "dims": self.dims, "bits": self.bits, "reps": self.reps, "seed": self.seed}

    def fingerprint(self) -> str:
        return hashlib.sha256(repr((self.dims, self.bits, self.reps, self.seed)).encode() + self.directions.tobytes()).hexdigest()

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """(n, reps) hashes by one matrix product."""
        signs = (x @ self.directions.reshape(-1, self.dims).T >= 0).reshape(len(x), self.reps, self.bits)
        return (signs * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).sum(-1)

    def hash(self, df: DataFrame) -> DataFrame:
        """(rep, hash, vec_id) of the rows of ``df`` (vec_id, v), in one pass without a shuffle."""
        directions = self.directions  # computed once, here

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n_reps, n_bits, dims = directions.shape
            weights = 1 << np.arange(n_bits - 1, -1, -1, dtype=np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack(batch["v"].to_numpy())
                signs = (x @ directions.reshape(-1, dims).T >= 0).reshape(len(x), n_reps, n_bits)
                h = (signs * weights).sum(-1)
                yield pd.DataFrame({"rep": np.tile(np.arange(n_reps, dtype=np.int32), len(x)), "hash": h.ravel(), "vec_id": np.repeat(batch["vec_id"].to_numpy(), n_reps)})

        return df.select("vec_id", "v").mapInPandas(task, "rep int, hash long, vec_id long")

    def collision_probability(self, distance: Column) -> Column:
        return probability.simhash_collision(distance)

    def probability(self, distance: np.ndarray) -> np.ndarray:
        """The same of an array of distances."""
        return 1 - np.arccos(np.clip(1 - distance, -1, 1)) / math.pi


class SimHashBuilder:
    """Draws independent hashes with one seed each."""

    def __init__(self, dims: int, bits: int, seed: int = 1234) -> None:
        self.dims, self.bits, self.seed = dims, bits, seed
        SimHash(dims, bits)

    def build(self) -> SimHash:
        return SimHash(self.dims, self.bits, 1, self.seed)

    def build_vec(self, reps: int) -> SimHash:
        return SimHash(self.dims, self.bits, reps, self.seed)
