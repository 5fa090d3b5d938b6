"""Operator 3: sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Each shard owns virtual nodes at hashed cells, and a row
belongs to the first virtual node clockwise of its id's hash. No shard takes more than its even share of the
rows: once it is full, the rows that follow in its cells continue clockwise to the next shard with room.
All rows that fit stay at home, so little moves when ids or shards come and go.

The driver sees one count per cell (a fixed number, whatever the input). The rows' places within a cell come
from a window per cell and part of it: a cell with many rows, as of one id or none, is dealt to parts by the rest of the
row, so no window holds it whole. Each row is shuffled once, without its text.

Law: ``rows`` (shard sizes differ by one at most). Defined results: a null text has no bytes, size 1 and
checksum 0; a null id hashes like any id; rows that repeat each other share their places in any order (if so many have one id that they crowd a cell, the places
of that cell's rows may differ between differently partitioned inputs); an empty table
gives no rows; other columns are kept (those of the query are its own), and may have any names but ``shard`` and ``slot``.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import cut, documents

CELL_BITS = 16
#: Rows of a cell in a part, about.
PART_ROWS = 4_096
#: Times the rows of the mean cell from which a cell is crowded by one key.
HOT = 8
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""
    nodes = []
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") >> (64 - CELL_BITS), shard))
    return sorted(nodes)


def ring_position(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 32)


def cell_of(position: Column) -> Column:
    return F.shiftrightunsigned(position, 32 - CELL_BITS).cast("int")


def deal(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, slot of the first), from the rows in each cell.

    First every shard keeps what its own cells hold, in ring order, up to its capacity. What is left over
    then walks clockwise to shards with room.
    """
    nodes = ring(shards, virtual_nodes)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (i < total % shards) for i in range(shards)]
    used = [0] * shards
    segments, over = [], []

    def put(cell: int, lo: int, n: int, shard: int) -> None:
        segments.append((cell, lo, lo + n, shard, used[shard]))
        used[shard] += n

    for cell in sorted(counts):
        at = bisect.bisect_left(cells, cell) % len(nodes)
        shard = nodes[at][1]
        n = min(counts[cell], room[shard] - used[shard])
        if n:
            put(cell, 0, n, shard)
        if n < counts[cell]:
            over.append((cell, n, counts[cell], at))
    for cell, lo, end, at in over:
        while lo < end:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            if n := min(end - lo, room[shard] - used[shard]):
                put(cell, lo, n, shard)
                lo += n
    return segments


def assign(df: DataFrame, key: str, shards: int, order_by: list[str]) -> DataFrame:
    """``df`` and columns ``shard`` and ``slot`` (gapless from 0 within a shard).

    ``order_by``: columns that tell rows with one key apart, so that reruns agree.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    at = ring_position(F.col(f"`{key}`"))
    # Rows that are equal in all of these take places in any order: they are told apart by a number.
    tie = F.monotonically_increasing_id()
    placed = cut(df.select(F.struct(*own).alias("row"), at.alias("at"), cell_of(at).alias("cell"), F.struct(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in order_by]).alias("by"), tie.alias("tie")))
    counts = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    segments = deal(counts, shards) or [(-1, 0, 0, 0, 0)]
    table = df.sparkSession.createDataFrame(segments, "c int, lo long, end long, shard int, first long")
    # A row's part follows from the row itself; in cells that one key crowds, where rows may be equal, from its number too.
    even = sum(counts.values()) / max(len(counts), 1)
    crowded = [(c, -(-n // PART_ROWS), n > HOT * even) for c, n in counts.items() if n > PART_ROWS] or [(-1, 1, False)]
    parts = F.broadcast(df.sparkSession.createDataFrame(crowded, "cell int, parts long, hot boolean"))
    part = F.pmod(F.xxhash64("at", "by", F.when(F.col("hot"), F.col("tie"))), F.coalesce("parts", F.lit(1)))
    dealt = placed.join(parts, "cell", "left").withColumn("part", part)
    sums = dealt.groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("cell", "part", F.coalesce(before, F.lit(0)).alias("base"))
    w = Window.partitionBy("cell", "part").orderBy("at", "by", "tie")
    ranked = dealt.withColumn("inside", F.row_number().over(w).cast("long") - 1).join(sums, ["cell", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("inside"))
    on = (F.col("cell") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("end"))
    # At most one row per cell and per overflow: bounded by the ring, so it is broadcast.
    return ranked.join(F.broadcast(table), on, "inner").select("row.*", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    return assign(rows, "doc_id", 16, ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
