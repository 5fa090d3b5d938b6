"""Operator 2: mixing sources to target weights.

A source's words, its documents end to end, are packed into fixed-length blocks. The mix is made of output
shards of as many slots. Each shard draws how many slots each source gets from a multinomial, by what the
sources still have to give, so that the totals meet the targets. A source's slots are numbered through all
shards; slot numbers run through the blocks by a pseudorandom permutation for each epoch; slots and blocks
are joined by block index. The last slot of a source takes only as many words as its target still lacks.

Everything is derived from the data and the seed, so reruns agree. The driver sees a row per source and draws a
count per (shard, source); the slots themselves are made in tasks. Offsets of documents within a source are prefix sums
in three steps, over groups of hash buckets, buckets and within them, so that one large source is spread over many tasks.

Defined results: null and blank texts have size 0 and are never taken; the null source is a source of its own,
last in order; rows that repeat each other share the words taken in an unspecified way between them; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import cut, documents, word_list

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 128
SHARD_SLOTS = 1 << 22
MIN_SHARDS = 16
BUCKET_ROWS = 256
GROUP_BUCKETS = 1 << 12
BUCKET_BLOCKS = 16
CHUNK = 1 << 14
TASK_SLOTS = 1 << 19
MAX_SOURCES = 100_000
SEED = 17


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``repeats`` times its size."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_ and total > 0:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            total -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draw(slots: list[int], shard_slots: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Each output shard's slots by source: multinomial by what is left, never more than is left."""
    left, rng = np.array(slots, dtype=np.int64), np.random.default_rng(seed)
    while (rest := int(left.sum())) > 0:
        want, got = min(shard_slots, rest), np.zeros(len(slots), dtype=np.int64)
        while want:
            free = left - got
            more = np.minimum(rng.multinomial(want, free / free.sum()), free)
            got += more
            want -= int(more.sum())
        left -= got
        yield got


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n-1 takes each index: a Feistel network over the next power
    of four, walked until it lands inside. ``key`` picks the permutation."""
    index, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, half, mask, key) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            z = right + key + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << half) | right

    out = once(index, half, mask, key)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside], half[outside], mask[outside], key[outside])
    return out.astype(np.int64)


def sized(df: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of each row of ``df``, written once: texts are not read again."""
    size = F.size(word_list(F.col("text"))).cast("long")
    return cut(df.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie")))


def sources(rows: DataFrame) -> pd.DataFrame:
    """A row per source, in order, with its weight and target. One row per component of the mix, not per
    document: more than MAX_SOURCES is an error, not a cut."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    table = pd.DataFrame({"source": [r["source"] for r in found], "size": [r["size"] for r in found], "n": [r["n"] for r in found]})
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(table))]
    table["target"] = targets([int(x) for x in table["size"]], weights)
    table["goal"] = [min(round(t), REPEATS * int(n)) for t, n in zip(table["target"], table["size"], strict=True)]
    return table


def offsets(rows: DataFrame, table: pd.DataFrame, *first) -> DataFrame:
    """Adds ``sid`` (the source's number), ``bucket``, ``rank`` and ``start``: where the row's words begin among its source's.
    Within a bucket rows come by the columns ``first``, then by id."""
    spark = rows.sparkSession
    ids = spark.createDataFrame([(i, s) for i, s in enumerate(table["source"])], "sid int, __source string")
    rows = rows.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    buckets = 1
    while buckets * BUCKET_ROWS < int(table["n"].max()):
        buckets *= 2
    # The hash of the row, not of the id: rows that share an id are spread too.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    return summed(rows, *first, "doc_id", "tie", "size")


def summed(rows: DataFrame, *order) -> DataFrame:
    """Adds ``rank`` (within the bucket) and ``start`` (sizes before the row) to ``rows`` (sid, bucket, size), which come by bucket
    and then by ``order`` within each source."""
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    groups = sums.groupBy("sid", "group").agg(F.sum("sum").alias("sum"))

    def before(keys: list[str], by: str) -> Column:
        return F.coalesce(F.sum("sum").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = groups.select("sid", "group", before(["sid"], "group").alias("first"))
    sums = sums.withColumn("base", before(["sid", "group"], "bucket")).join(groups, ["sid", "group"])
    sums = sums.select("sid", "bucket", (F.col("base") + F.col("first")).alias("base"))
    w = Window.partitionBy("sid", "bucket").orderBy(*order)
    placed = rows.withColumns(
        {
            "rank": F.row_number().over(w),
            "inside": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    return placed.join(sums, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def shares(table: pd.DataFrame, block: int) -> tuple[list[int], int]:
    """How many slots each source's goal takes, and how many an output shard has."""
    pairs = zip(table["size"].astype(int).tolist(), table["goal"].astype(int).tolist(), strict=True)
    number = [0 if not n else (g // n) * -(-n // block) + -(-(g % n) // block) for n, g in pairs]
    return number, min(SHARD_SLOTS, max(1, -(-sum(number) // MIN_SHARDS)))


def slots(spark: SparkSession, table: pd.DataFrame, block: int = BLOCK, seed: int = SEED, whole: bool = False) -> DataFrame:
    """(sid, block, epoch, words): what each slot of the mix takes of which block.

    Within an epoch the full blocks come in permuted order; a short last block ends it. ``whole``: also (shard, at), the
    output shard and the place in the epoch; and slots beyond the goal, to the end of its epoch, in the last shard.
    """
    sizes, goals = table["size"].astype(int).tolist(), table["goal"].astype(int).tolist()
    per_epoch = [-(-n // block) for n in sizes]
    number, shard_slots = shares(table, block)
    chunks, begun = [], [0] * len(sizes)
    for shard, got in enumerate(draw(number, shard_slots, seed)):
        for sid in np.flatnonzero(got):
            chunks.append((shard, int(sid), begun[sid], begun[sid] + int(got[sid])))
            begun[sid] += int(got[sid])
    schema = "sid int, block long, epoch long, words long" + ", shard int, at long" * whole
    if not chunks:
        return spark.createDataFrame([], schema)
    if whole:
        more = [(sid, n, -(-n // e) * e) for sid, (n, e) in enumerate(zip(number, per_epoch, strict=True)) if n]
        chunks += [(chunks[-1][0], sid, n, end) for sid, n, end in more if n < end]
    keys = [int.from_bytes(hashlib.blake2b(f"{seed}:{s}".encode(), digest_size=7).digest(), "big") for s in table["source"]]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, goal, full = np.array(sizes), np.array(goals), np.array(sizes) // block
        key, rounds = np.array(keys, dtype=np.int64), np.array(per_epoch)
        for batch in batches:
            for shard, sid, lo, end in batch[["shard", "sid", "lo", "end"]].itertuples(index=False):
                j = np.arange(lo, end)
                epoch, at = j // rounds[sid], j % rounds[sid]
                inside = at < full[sid]
                index = at.copy()
                if inside.any():
                    n = np.full(int(inside.sum()), full[sid])
                    index[inside] = permuted(at[inside], n, key[sid] + epoch[inside])
                words = np.minimum(block, size[sid] - index * block)
                # Of the slots before it in the epoch all are full blocks.
                words = np.minimum(words, goal[sid] - epoch * size[sid] - at * block)
                found = {"sid": np.full(len(j), sid, dtype=np.int32), "block": index, "epoch": epoch, "words": words}
                yield pd.DataFrame(found | ({"shard": np.full(len(j), shard, dtype=np.int32), "at": at} if whole else {}))

    frame = spark.createDataFrame(chunks, "shard int, sid int, begin long, last long")
    frame = frame.withColumn("lo", F.explode(F.sequence("begin", F.col("last") - 1, F.lit(CHUNK))))
    frame = frame.select("shard", "sid", "lo", F.least(F.col("lo") + CHUNK, "last").alias("end"))
    tasks = sum(number) // TASK_SLOTS + 1
    return frame.repartition(tasks, "shard", "sid", "lo").mapInPandas(task, schema)


def taken(rows: DataFrame, table: pd.DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per (row of ``rows``, epoch) with words in the mix, besides one with epoch null for a row without:
    sid, bucket, rank, epoch, taken and the row's own columns."""
    spark = rows.sparkSession
    placed = offsets(rows, table)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last))
    pieces = placed.withColumn("block", F.explode_outer(blocks))
    # Slots grow with the input though their shuffled bytes are few: never broadcast.
    found = pieces.join(slots(spark, table, block).hint("merge"), ["sid", "block"], "left")
    lo = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    found = found.withColumn("got", F.when(F.col("words").isNull(), 0).otherwise(F.greatest(end - lo, F.lit(0))))
    own = ["doc_id", "source", "size"]
    return found.groupBy("sid", "bucket", "rank", "epoch").agg(*[F.first(c).alias(c) for c in own], F.sum("got").alias("taken"))


def mix(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text, source): size, source_size, target and taken."""
    rows = sized(df)
    table = sources(rows)
    if not len(table):
        return df.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    by = df.sparkSession.createDataFrame(
        [(i, int(n), float(t)) for i, (n, t) in enumerate(zip(table["size"], table["target"], strict=True))], "sid int, source_size long, target double"
    )
    got = taken(rows, table).groupBy("sid", "bucket", "rank").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum("taken").alias("taken"))
    return got.join(F.broadcast(by), "sid").select("doc_id", "size", "source_size", "target", "taken")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """Pipeline stage: the mix, in whole documents. A slot gives out the documents that begin in its block. A source's slots come
    in their order, and it gives out the documents whose middle lies before its goal, so its words miss the goal by half a
    document at most. Each output shard is a partition, or as many neighbouring ones as it needs. Rows that share id,
    source and text share their copies evenly. ``docs`` may have any columns besides doc_id, text and source. Null and
    blank texts are never given out; an empty table stays empty."""
    rows = sized(docs)
    table = sources(rows)
    if not len(table):
        return docs
    # The struct is never null, so that ids and sources that are null meet.
    key = lambda own: F.struct(F.col(f"{own}doc_id").alias("doc_id"), F.col(f"{own}source").alias("source"))
    placed = offsets(rows, table).where("size > 0").select("sid", "start", "size", key("").alias("key"), F.col("tie").alias("t"))
    begins = placed.withColumn("block", F.floor(F.col("start") / block))
    met = begins.join(slots(spark, table, block, whole=True).hint("merge"), ["sid", "block"])
    goals = [(i, g // n if n else 0, g % n if n else 0) for i, (n, g) in enumerate(zip(table["size"].astype(int).tolist(), table["goal"].astype(int).tolist(), strict=True))]
    met = met.join(F.broadcast(spark.createDataFrame(goals, "sid int, epochs long, rest long")), "sid")
    met = cut(met.select("sid", "size", "key", "t", "epoch", "shard", "at", F.col("start").alias("first"), "epochs", "rest"))
    # Blocks hold as many beginnings as words at most, so buckets are bounded.
    last = summed(met.where("epoch >= epochs").withColumn("bucket", F.floor(F.col("at") / BUCKET_BLOCKS)), "at", "first")
    given = met.where("epoch < epochs").select("key", "t", "shard").unionByName(last.where("2 * start + size <= 2 * rest").select("key", "t", "shard"))
    shards = given.groupBy("key", "t", "shard").count().groupBy("key", "t").agg(F.sort_array(F.collect_list(F.struct("shard", "count"))).alias("shards"))
    # The row is one column, so that its names clash with none.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("t"))
    keys = Window.partitionBy("key", "t")
    alone = keyed.withColumn("key", key("row.")).join(shards, ["key", "t"])
    alone = alone.withColumns({"n": F.count("*").over(keys), "k": F.row_number().over(keys.orderBy(F.xxhash64("row")))})
    # Of all copies of equal rows the k-th of n rows has the k-th, and each n-th after it.
    total = F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    own = F.when(F.col("k") <= total, F.sequence(F.col("k").cast("long"), total, F.col("n")))
    each = alone.select("row", "shards", F.explode(own).alias("c"))
    state = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("shard"))

    def find(a: Column, x: Column) -> Column:
        end = a["before"] + x["count"]
        return F.struct(end.alias("before"), F.coalesce(a["shard"], F.when(F.col("c") <= end, x["shard"])).alias("shard"))

    each = each.select("row", F.aggregate("shards", state, find, lambda a: a["shard"]).alias("shard"))
    number, shard_slots = shares(table, block)
    count, parts = max(1, -(-sum(number) // shard_slots)), -(-shard_slots // TASK_SLOTS)
    part = F.pmod(F.xxhash64("row.doc_id", F.xxhash64("row.text")), F.lit(parts)).cast("int")
    return each.repartitionById(count * parts, F.col("shard") * parts + part).select("row.*")
