"""Cross-polytope hashing: pseudorandom rotations, then the closest signed axis."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecmill.functions.hadamard import butterfly
from vecmill.operators.simhash import gaussian
from vecmill.sources.vectors import ANGULAR

ROTATIONS = 3


def sign(tag: str, *key: int) -> int:
    return 1 if int(hashlib.md5(":".join((tag, *map(str, key))).encode()).hexdigest()[0], 16) % 2 else -1


def diagonal_multiply(v: Column, diagonal: Column) -> Column:
    return F.zip_with(v, diagonal, lambda x, s: x * s)


def closest_axis(v: Column, dims: int, power: int) -> Column:
    """i for the axis +i, i + power for -i; of equal parts the first; only the first ``dims`` parts count."""
    sized = F.transform(F.slice(v, 1, dims), lambda x: F.abs(x))
    at = F.array_position(sized, F.array_max(sized)).cast("int") - 1
    return at + F.when(F.get(v, at) < 0, F.lit(power)).otherwise(0)


def axes(v: np.ndarray, diagonals: np.ndarray, dims: int, power: int) -> list[np.ndarray]:
    """The symbol of each row of ``v`` for each function."""
    x = np.zeros((len(v), power))
    x[:, :dims] = v
    out = []
    for rotations in diagonals:
        y = x
        for d in rotations:
            y = butterfly(y * d)
        out.append(closest(y[:, :dims], power))
    return out


@dataclass(frozen=True)
class CrossPolytope:
    dims: int
    functions: int = 1
    seed: int = 1234

    @property
    def power(self) -> int:
        return 1 << max(0, (self.dims - 1).bit_length())

    @property
    def bits_per_function(self) -> int:
        return self.power.bit_length()

    @cached_property
    def diagonals(self) -> np.ndarray:
        """(functions, rotations, power) of +1 and -1"""
        tag = f"cross{self.seed}"
        return np.array([[[sign(tag, f, r, d) for d in range(self.power)] for r in range(ROTATIONS)] for f in range(self.functions)], dtype=np.float64)

    def hash(self, df: DataFrame) -> DataFrame:
        """(vec_id, symbols array<int>) of the rows of ``df`` (vec_id, v), in one pass without a shuffle."""
        diagonals, dims, power = self.diagonals, self.dims, self.power

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                symbols = axes(np.stack(batch["v"].to_numpy()), diagonals, dims, power)
                yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "symbols": list(np.stack(symbols, 1).astype(np.int32))})

        return df.select("vec_id", "v").mapInPandas(task, "vec_id long, symbols array<int>")


@dataclass(frozen=True)
class CrossPolytopeHash:
    """``reps`` hashes of ``bits`` cross-polytope functions each, for an index: symbols packed into one long."""

    dims: int
    bits: int = 4
    reps: int = 1
    seed: int = 1234
    metrics = (ANGULAR,)

    def __post_init__(self) -> None:
        if self.dims < 1 or self.reps < 1 or self.bits < 1 or self.bits * self.unit > 62:
            raise ValueError("dims, reps and bits must be 1 or more, and all symbols of a hash fit 62 bits")

    @property
    def unit(self) -> int:
        return CrossPolytope(self.dims).bits_per_function

    def family(self, rep: int) -> CrossPolytope:
        return CrossPolytope(self.dims, self.bits, self.seed + rep)

    def hash(self, df: DataFrame) -> DataFrame:
        """(rep, hash, vec_id) of the rows of ``df`` (vec_id, v), in one pass without a shuffle."""
        families = [self.family(r) for r in range(self.reps)]
        turns, unit = [(f, f.diagonals) for f in families], self.unit

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                v = np.stack(batch["v"].to_numpy())
                for rep, (family, diagonals) in enumerate(turns):
                    h = np.zeros(len(v), dtype=np.int64)
                    for symbols in axes(v, diagonals, family.dims, family.power):
                        h = (h << unit) | symbols
                    yield pd.DataFrame({"rep": np.full(len(v), rep, dtype=np.int32), "hash": h, "vec_id": batch["vec_id"].to_numpy()})

        return df.select("vec_id", "v").mapInPandas(task, "rep int, hash long, vec_id long")

    @cached_property
    def grid(self) -> np.ndarray:
        """The simulated chances at evenly spaced inner products from -1 to 1."""
        return simulated(CrossPolytope(self.dims).power, 40, 4_000, self.seed)

    def probability(self, distance: np.ndarray) -> np.ndarray:
        return np.interp(1 - np.asarray(distance, dtype=float), np.linspace(-1, 1, len(self.grid)), self.grid)

    def collision_probability(self, distance: Column) -> Column:
        steps, table = len(self.grid) - 1, F.array(*[F.lit(float(p)) for p in self.grid])
        at = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)) + 1) * steps / 2
        low = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
        return F.get(table, low) + (at - low) * (F.get(table, low + 1) - F.get(table, low))

    def spec(self) -> dict:
        return {"family": "cross-polytope", "dims": self.dims, "bits": self.bits, "reps": self.reps, "seed": self.seed}

    def fingerprint(self) -> str:
        signs = b"".join(self.family(r).diagonals.tobytes() for r in range(self.reps))
        return hashlib.sha256(repr(sorted(self.spec().items())).encode() + signs).hexdigest()


def closest(x: np.ndarray, power: int) -> np.ndarray:
    """The closest signed axis of each row."""
    at = np.abs(x).argmax(1)
    return at + power * (x[np.arange(len(x)), at] < 0)


def agreements(samples: range, grid: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """For each inner product of the grid, how many of the samples, pairs of Gaussian vectors, share an axis."""
    p, other = (np.array([[gaussian(f"pair{seed}", side, k, d) for d in range(dims)] for k in samples]).reshape(-1, dims) for side in (0, 1))
    own = closest(p, dims)
    return np.array([int((own == closest(a * p + np.sqrt(max(0.0, 1 - a * a)) * other, dims)).sum()) for a in grid])


def simulated(dims: int, steps: int, samples: int, seed: int) -> np.ndarray:
    return agreements(range(samples), np.round(np.linspace(-1, 1, steps + 1), 9), dims, seed) / samples


def probabilities(spark: SparkSession, dims: int, steps: int = 40, samples: int = 10_000, seed: int = 1234, chunk: int = 250) -> DataFrame:
    """(dim, dotp, p): the simulated chance that two unit vectors at inner product ``dotp`` share an axis, on an
    integer grid over [-1, 1]. Chunks of samples are independent tasks whose counts are summed; the samples come from
    digests, so that other engines can rebuild them."""
    grid = np.round(np.linspace(-1, 1, steps + 1), 9)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in batch["id"]:
                part = range(int(lo) * chunk, min((int(lo) + 1) * chunk, samples))
                yield pd.DataFrame({"dotp": grid, "hits": agreements(part, grid, dims, seed)})

    found = spark.range(-(-samples // chunk)).mapInPandas(task, "dotp double, hits long")
    return found.groupBy("dotp").agg((F.sum("hits") / samples).alias("p")).select(F.lit(dims).alias("dim"), "dotp", "p")


def cached_probabilities(spark: SparkSession, folder: str, dims: int, steps: int = 40, samples: int = 10_000) -> DataFrame:
    """The table from ``folder`` if it is there, else simulated and written."""
    path = f"{folder}/cross-polytope-{dims}-{steps}-{samples}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    probabilities(spark, dims, steps, samples).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.orderBy("dotp").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def interpolated(df: DataFrame, column: str, table: DataFrame, steps: int = 40) -> DataFrame:
    """``df`` and ``p``: the probability at the inner product in ``column``, linear between the grid's points."""
    at = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(column))) + 1) * steps / 2
    low = F.least(F.floor(at), F.lit(steps - 1))
    grid = table.select(F.round((F.col("dotp") + 1) * steps / 2).cast("long").alias("k"), F.col("p"))
    a, b = (F.broadcast(grid.select(F.col("k").alias(f"k{i}"), F.col("p").alias(f"p{i}"))) for i in (0, 1))
    out = df.withColumns({"__low": low, "__part": at - low})
    out = out.join(a, F.col("__low") == F.col("k0")).join(b, F.col("__low") + 1 == F.col("k1"))
    return out.select(*df.columns, (F.col("p0") + F.col("__part") * (F.col("p1") - F.col("p0"))).alias("p"))
