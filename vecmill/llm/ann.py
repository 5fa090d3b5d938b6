"""Operator 4: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to the unit sphere (one more coordinate makes all norms equal, so that the largest inner
product is the nearest point). A table cuts the line of each of FUNCTIONS Gaussian projections into slots; a
bucket is a slot for each. For a query the chance that a neighbour lies in a bucket follows from the query's
projections and the similarity that neighbours have; buckets are visited in falling order of that estimate
until it sums up to the wanted success. All vectors of the visited buckets are compared exactly, in double
precision, and the tables' candidates are merged.

The first round takes the similarity measured on CALIBRATION queries, which are compared with all rows. After each
round every query is judged by its own k-th score so far: it goes on through the buckets that the estimate for this
score still wants, and through all the remaining ones if it has fewer than k rows. So the first round's similarity
only fixes costs. So do the number of functions, which follows from the number of rows, and that of tables, which is
the one that would visit least on a bounded sample of rows: the less structure the data has, the fewer.

Buckets are dealt to shards in order, so that a shard holds buckets that lie together; a bucket with more than
BUCKET_ROWS rows is split, so that many copies of one vector are spread. Queries are dealt to blocks by their likeliest
bucket. Each task compares one block of queries with one shard and returns a top list; only pairs of a block and a
shard that some query visits are sent anywhere.

Defined results: vectors that are null, zero, of another length than most or hold null or non-finite parts
take no part; a repeated id counts once, with its best score; a row is never its own neighbour; without
candidates there are no rows; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import cut

#: Numbers of tables to choose from.
TABLES = (1, 2, 4)
#: Functions of a hash: at least, at most, and rows for which a bucket more is worth its place in each query's order.
FUNCTIONS = (2, 8)
ROWS_PER_BUCKET = 12
WIDTH = 1.0
SLOTS = 4
SUCCESS = 0.96
CALIBRATION = 48
CALIBRATION_ROWS = 4_096
SHARD_ROWS = 32_768
BUCKET_ROWS = 4_096
QUERY_BLOCK = 8_192
#: Queries whose buckets are put in order at a time, by the number of buckets.
ORDER_CELLS = 1 << 20
SEED = 3
#: In place of a similarity: all buckets are visited.
EVERYWHERE = -2.0


@dataclass(frozen=True)
class Hashes:
    """Projections (tables, functions, dims + 1), slot edges (tables, functions, SLOTS - 1), largest norm."""

    directions: np.ndarray
    edges: np.ndarray
    norm: float

    @property
    def tables(self) -> int:
        return self.directions.shape[0]

    @property
    def functions(self) -> int:
        return self.directions.shape[1]

    @property
    def share(self) -> float:
        """The success that each table must reach for all of them to reach SUCCESS together, per ``probes``."""
        return 1 / self.tables

    @staticmethod
    def draw(dims: int, norm: float, tables: int = 2, functions: int = 6, seed: int = SEED) -> "Hashes":
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(tables, functions, dims + 1))
        start = rng.uniform(-WIDTH / 2, WIDTH / 2, size=(tables, functions, 1))
        return Hashes(directions, start + WIDTH * (np.arange(SLOTS - 1) - (SLOTS - 2) / 2), norm)

    def projections(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tfd->tnf", unit, self.directions)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, n) bucket numbers of data vectors."""
        slot = (self.projections(self.points(x))[..., None] >= self.edges[:, None]).sum(-1)
        return (slot * SLOTS ** np.arange(self.functions)).sum(-1)

    def chances(self, x: np.ndarray, similarity: float | np.ndarray) -> np.ndarray:
        """(tables, n, buckets): the chance that a neighbour of each query lies in a bucket."""
        t = self.projections(self.queries(x))
        similarity = np.broadcast_to(np.clip(similarity, -0.99, 0.99), len(x))[:, None, None]
        spread = np.sqrt(np.maximum(1e-6, 1 - similarity * similarity))
        below = np.vectorize(math.erf, otypes=[float])((self.edges[:, None] - similarity * t[..., None]) / (spread * math.sqrt(2)))
        cdf = np.concatenate([np.zeros((*t.shape, 1)), (1 + below) / 2, np.ones((*t.shape, 1))], axis=-1)
        p = np.diff(cdf, axis=-1)
        out = p[:, :, 0]
        for k in range(1, self.functions):
            out = (p[:, :, k][..., None] * out[..., None, :]).reshape(*out.shape[:2], -1)
        return out

    def probes(self, x: np.ndarray, similarity: float | np.ndarray, success: float = SUCCESS) -> np.ndarray:
        """(tables, n, buckets) of bool: those visited, by falling chance, until the tables together reach
        ``success``. A similarity, of all queries or of each, of EVERYWHERE visits all buckets."""
        chance = self.chances(x, similarity)
        order = np.argsort(-chance, axis=-1, kind="stable")
        total = np.take_along_axis(chance, order, -1).cumsum(-1)
        visit = total - np.take_along_axis(chance, order, -1) < 1 - (1 - success) ** self.share
        out = np.zeros(chance.shape, dtype=bool)
        np.put_along_axis(out, order, visit, -1)
        return out | (np.broadcast_to(similarity, len(x)) == EVERYWHERE)[:, None]

    def left(self, x: np.ndarray, past: list[np.ndarray], now: np.ndarray, success: float = SUCCESS) -> np.ndarray:
        """Like ``probes``: what each query must still visit for ``now`` after its rounds of similarities ``past``. Nothing
        in a table whose visited buckets reach the success by themselves."""
        visited = np.zeros((self.tables, len(x), SLOTS**self.functions), dtype=bool)
        for i in range(max(map(len, past), default=0)):
            who = np.array([r for r, p in enumerate(past) if len(p) > i])
            visited[:, who] |= self.probes(x[who], np.array([past[r][i] for r in who]), success)
        reached = (self.chances(x, now) * visited).sum(-1) >= 1 - (1 - success) ** self.share
        reached &= now != EVERYWHERE
        return self.probes(x, now, success) & ~visited & ~reached[..., None]


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm) of the rows that take part; written once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = df.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0")
    return cut(rows)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of ``scores``, ties to smaller ids; ids are a row or one row per row."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        # All that tie with the k-th stay in, for the ids to decide.
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= floor[:, None]).sum(1).max())
        top = np.argpartition(-scores, min(width, scores.shape[1] - 1) - 1 if width < scores.shape[1] else scores.shape[1] - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 1))


def calibrate(rows: DataFrame, queries: DataFrame, k: int, norm: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The median similarity of the k-th neighbours of a few queries, by exact search; these queries and theirs."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not few:
        return 0.0, np.empty((0, 1)), np.empty(0)
    ids, raw = np.array([r["vec_id"] for r in few]), np.array([r["v"] for r in few])
    q = raw / np.linalg.norm(raw, axis=1, keepdims=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = q @ matrix(batch["v"]).T
            s[ids[:, None] == batch["vec_id"].to_numpy()[None]] = -np.inf
            s = -np.sort(-s, axis=1)[:, :k]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), s.shape[1]), "s": s.ravel()})

    top = Window.partitionBy("q").orderBy(F.desc("s"))
    found = rows.select("vec_id", "v").mapInPandas(task, "q int, s double").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    last = found.groupBy("q").agg(F.min("s").alias("s")).orderBy("q").toPandas()["s"].to_numpy() / norm
    last = np.where(np.isfinite(last), last, 0.0)
    return float(np.clip(np.quantile(last, 0.5), 0.0, 0.99)), raw, last


def drawn(rows: DataFrame, n: int, dims: int, norm: float, queries: np.ndarray, similarity: np.ndarray, success: float) -> Hashes:
    """Hash functions for ``n`` rows: of the numbers of tables, that with which the calibration queries visit least."""
    least, most = FUNCTIONS
    functions = int(np.clip(round(math.log(max(n / ROWS_PER_BUCKET, 1), SLOTS)), least, most))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(CALIBRATION_ROWS).select("v").collect()
    points, best = np.array([r["v"] for r in sample]), None
    for tables in TABLES:
        hashes = Hashes.draw(dims, norm, tables, functions)
        probes, buckets = hashes.probes(queries, similarity, success), hashes.buckets(points)
        cost = sum(probes[t][:, buckets[t]].sum() for t in range(tables)) + probes.size / ROWS_PER_BUCKET
        if best is None or cost < best[0]:
            best = (cost, hashes)
    return best[1]


def search(df: DataFrame, is_query, k: int = 20, success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` (vec_id, embedding) that ``is_query`` selects."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors(df)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["d"]
    rows = rows.where(F.size("v") == dims)
    norm = rows.agg(F.max("norm")).first()[0]
    queries = rows.where(is_query)
    similarity, few, own = calibrate(rows, queries, k, norm)
    if not len(few):
        return spark.createDataFrame([], schema)
    hashes = drawn(rows, rows.count(), dims, norm, few, own, success)
    step = max(1, ORDER_CELLS // (hashes.tables * SLOTS**hashes.functions))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, bucket in enumerate(hashes.buckets(matrix(batch["v"]))):
                yield batch[["vec_id", "v"]].assign(table=t, bucket=bucket)

    index = rows.select("vec_id", "v").mapInPandas(hashed, "vec_id long, v array<double>, table int, bucket int")
    index = cut(index)
    # One count per bucket: some 65,000 a table at most, whatever the input.
    counts = {(r["table"], r["bucket"]): r["count"] for r in index.groupBy("table", "bucket").count().collect()}
    place, filled = [], dict.fromkeys(range(hashes.tables), 0)
    for (t, b), n in sorted(counts.items()):
        parts = -(-n // BUCKET_ROWS)
        for part in range(parts):
            place.append((t, b, part, filled[t] // SHARD_ROWS, parts))
            filled[t] += -(-n // parts)
    of: dict[tuple[int, int], list[int]] = {}
    for t, b, _, shard, _ in place:
        if b not in of.setdefault((t, shard), [])[-1:]:
            of[t, shard].append(b)
    place = spark.createDataFrame(place, "table int, bucket int, part int, shard int, parts int")
    split = index.join(F.broadcast(place.select("table", "bucket", "parts").distinct()), ["table", "bucket"])
    split = split.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    data = split.join(F.broadcast(place.drop("parts")), ["table", "bucket", "part"])

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                yield part.assign(home=hashes.chances(matrix(part["v"]), similarity)[0].argmax(-1).astype(np.int32))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                probes = hashes.left(matrix(part["v"]), list(part["past"]), part["now"].to_numpy(), success)
                for (t, s), own in of.items():
                    visit = [np.array(own)[row].tolist() for row in probes[t][:, own]]
                    out = part[["block", "vec_id", "v"]].assign(table=t, shard=s, visit=visit)
                    yield out[[len(x) > 0 for x in visit]][["table", "shard", "block", "vec_id", "v", "visit"]]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries that are not done, with the similarity of their next round."""
        occupied = np.zeros((hashes.tables, 1, SLOTS**hashes.functions), dtype=bool)
        for t, b in counts:
            occupied[t, 0, b] = True
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                x, past = matrix(part["v"]), [np.append(p, n) for p, n in zip(part["past"], part["now"], strict=True)]
                now = np.clip(part["kth"].to_numpy(dtype=float) / (np.linalg.norm(x, axis=1) * norm), -0.99, 0.99)
                now = np.where(part["found"].to_numpy() < k, EVERYWHERE, now)
                more = (hashes.left(x, past, now, success) & occupied).any(axis=(0, 2))
                yield part[["vec_id", "v"]].assign(past=past, now=now)[more]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x, ids, bucket = matrix(left["v"]), left["vec_id"].to_numpy(), left["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        x, ids, bucket = x[order], ids[order], bucket[order]
        q, qid = matrix(right["v"]), right["vec_id"].to_numpy()
        row = np.repeat(np.arange(len(q)), [len(v) for v in right["visit"]])
        visited = np.concatenate([np.asarray(v) for v in right["visit"]])
        by = np.argsort(visited, kind="stable")
        row, visited = row[by], visited[by]
        top_s, top_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
            who = row[np.searchsorted(visited, bucket[lo]) : np.searchsorted(visited, bucket[lo], side="right")]
            for at in range(0, len(who), 512):
                some = who[at : at + 512]
                s = q[some] @ x[lo:hi].T
                s[qid[some][:, None] == ids[lo:hi][None]] = -np.inf
                both = np.hstack([top_s[some], s]), np.hstack([top_i[some], np.broadcast_to(ids[lo:hi], s.shape)])
                top_s[some], top_i[some] = best(*both, k)
        real = np.isfinite(top_s)
        return pd.DataFrame(dict(zip(names, (np.repeat(qid, k).reshape(-1, k)[real], top_i[real], top_s[real]), strict=True)))

    keys, state = ["table", "shard", "block"], "vec_id long, v array<double>, past array<double>, now double"
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def asking(queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of the buckets that ``queries`` (of ``state``) visit now."""
        near = cut(queries.mapInPandas(homes, f"{state}, home int"))
        # One count per bucket again: a block holds the queries of buckets that lie together, a large bucket's several.
        block, begun, dealt = 0, 0, []
        for home, n in sorted((r["home"], r["count"]) for r in near.groupBy("home").count().collect()):
            if begun and begun + n > QUERY_BLOCK:
                block, begun = block + 1, 0
            parts = max(1, -(-n // QUERY_BLOCK))
            dealt.append((home, block, parts))
            block, begun = (block + parts, 0) if parts > 1 else (block, begun + n)
        dealt = F.broadcast(spark.createDataFrame(dealt or [(-1, 0, 1)], "home int, first int, parts int"))
        asked = near.join(dealt, "home").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
        asked = cut(asked.select("vec_id", "v", "past", "now", "block").mapInPandas(probed, "table int, shard int, block int, vec_id long, v array<double>, visit array<int>"))
        # Names of its own: the pairs come from the same rows as the other side of the cogroup.
        met = asked.select(F.col("table").alias("t"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
        held = data.join(met, (F.col("table") == F.col("t")) & (F.col("shard") == F.col("s"))).select("table", "shard", F.col("b").cast("int").alias("block"), "bucket", "vec_id", "v")
        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return cut(merged.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k))

    # A bounded number of rows stays in few partitions, so that tasks have enough to do.
    pending = queries.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, queries.count() // 256 + 1))).select("vec_id", "v", F.array().cast("array<double>").alias("past"), F.lit(similarity).alias("now"))
    names = ["query_id", "vec_id", "score"]
    found = ranked(asking(pending))
    # Each round visits buckets that its queries have not seen, so the rounds end.
    while True:
        so_far = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"), F.min("score").alias("kth"))
        waiting = pending.join(so_far, "vec_id", "left").fillna(0, ["found"]).fillna(0.0, ["kth"])
        pending = cut(waiting.mapInPandas(judged, state))
        if pending.isEmpty():
            return found.select("query_id", "rank", "vec_id", "score")
        found = ranked(found.select(*names).unionByName(asking(pending)))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(df, F.col("vec_id") % 20 == 0)
