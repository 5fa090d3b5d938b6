"""Operator 8: n-gram Jaccard self-join by a token-group matrix, exact, up to connected components.

Documents with equal shingle sets are one node. Each node is compared with the leaders of its min-hash keys (the text
that most copies of a family stem from); nodes near a leader form a group around it, linked or not. A node is then
described by its differences to the leader: the shingles that only one of the two holds. Then the exact part:

* The matrix stores, per token and group, that the union of the members' prefixes (rarest shingles first; a pair that
  links must share some) holds it, with size range and overlap bounds. It is aggregated before it is shuffled: a
  family of copies costs one row per token. A node of the smaller group that shares too few tokens with the union, or
  whose overlap bound is too low, passes the group by.
* Otherwise the node is compared with the group's leader. Differences are a metric: the group qualifies for the node
  only if its radius admits a link, and only qualifying groups are opened.
* In an opened group (its own one, and those a node visits) two nodes that are not linked yet can link only if they
  share enough of their differences to the leader, since at least one of them failed against it. So they meet at their
  rarest differences, a prefix filter over sets that are small among copies, and what they share decides.

No pair within a group is made but at shared differences, yet no link between different texts is lost: prefix filters
are exact under any order of the tokens, and a bad choice of leaders or groups costs time only.

Shingles and sets are held as 64-bit hashes; a second hash of each set tells if two sets clash, which starts the work
anew with another seed.

Defined results: null and wordless texts have no set and link with nothing; rows that repeat each other are linked;
texts that share an id are told apart; rows without id link like others, but their component_id is null; an empty table
gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import Tables, documents, release
from vecmill.llm.components import components

#: Tokens kept of the heavy-hitter summaries, of each partition's and of all: they fix an order, no result.
HEAVY_LOCAL = 1 << 13
HEAVY = 1 << 17
MIN_HASHES = 12
#: A linked pair shares this many tokens of its prefixes (less in very small sets).
HITS = 3
#: A list of ids or tokens up to this size is broadcast, at this many bytes a row in a hash table; beyond, it is shuffled.
BROADCAST_BYTES = 2 << 20
BROADCAST_ROW = 32
#: Words of 64 bits of a sieve, which takes out most rows that a longer list does not hold before the rest is shuffled.
SIEVE = 1 << 18
#: Texts that a task hashes at a time.
CHUNK = 1_000
#: Similarity to a leader, in percent, from which a node belongs to its group; and how much less than its best a node
#: accepts to follow a leader that more nodes follow. Both fix costs, no result.
NEAR = 50
SLACK = 15

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 62)) * 4 + 3
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, of n or more exponents."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(14, int(n).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each blank-separated word, A-Z lower-cased; all words of a text in one pass over its bytes."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    blank = np.concatenate(([True], _BLANK[raw], [True]))
    change = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)))
    return _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < n:
        return _mix(np.array([(w * _MUL[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))
    m = len(w) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h += w[k : k + m] * _MUL[k]
    return np.unique(_mix(h))


def needed(size, percent: int):
    """Least overlap of a set with any set it links with."""
    return -(-percent * size // 100)


def heavy_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their rough number of texts, from a bounded summary of every partition."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for texts in (batch["text"].iloc[lo : lo + CHUNK] for batch in batches for lo in range(0, len(batch), CHUNK)):
            sets = [shingles(t, n) for t in texts]
            own, times = np.unique(np.concatenate(sets) if sets else tokens, return_counts=True)
            twice = times > 1
            tokens, at = np.unique(np.concatenate((tokens, own[twice])), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, times[twice])), len(tokens)).astype(np.int64)
            if len(tokens) > HEAVY_LOCAL:
                top = np.sort(np.argpartition(-counts, HEAVY_LOCAL)[:HEAVY_LOCAL])
                tokens, counts = tokens[top], counts[top]
        yield pd.DataFrame({"token": tokens.view(np.int64), "n": counts})
        release()

    found = docs.select("text").mapInPandas(task, "token long, n long")
    top = found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(dtype=np.int64)[order]


def place(count: int, token: int) -> int:
    """A number that rises with a token's place in the order of all tokens, by count and token. Equal numbers leave the
    order open: counts above what 40 bits hold are not told apart, so their tokens must not be compared either."""
    most = (1 << 40) - 1
    return most << 23 if count >= most else (count << 23) | (token >> 41)


def digest(sorted_hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set: its name, and one to tell clashes."""
    raw = hashlib.blake2b(sorted_hashes.tobytes(), digest_size=16, salt=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signatures(docs: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """(doc_id, node, check, size, rare, end, keys, prefix) of each row. ``rare`` counts the shingles that are no heavy
    hitters: it is least for the text that most copies of a family stem from. ``end`` rises with the place of the
    prefix's last token in the order of all tokens."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs, n))
    mul, names = _RNG_KEYS, ["node", "check", "size", "rare", "end", "keys", "prefix"]

    def one(text):
        s = shingles(text, n)
        if not len(s):
            return None, None, 0, 0, 0, [], []
        tokens, counts = heavy.value
        cls = np.zeros(len(s), dtype=np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            cls = np.where(tokens[at] == s, counts[at], 0)
        least = needed(len(s), percent)
        length = len(s) - least + min(HITS, least)
        order = np.lexsort((s, cls))[:length]
        prefix = s[order]
        end = place(int(cls[order[-1]]), int(prefix[-1]))
        mins = np.array([(s * m).min() for m in mul])
        keys = _mix(mins[::2] * np.uint64(3) + _mix(mins[1::2])) ^ np.arange(len(mins) // 2, dtype=np.uint64)
        return *digest(s, seed), len(s), int((cls == 0).sum()), end, keys.view(np.int64), prefix.view(np.int64)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.iloc[lo : lo + CHUNK]
                columns = dict(zip(names, zip(*[one(t) for t in part["text"]], strict=True), strict=True))
                # Never by way of floats, which hold no 64 bits.
                exact = {c: pd.array(columns[c], dtype="Int64") for c in ("node", "check")}
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **columns, **exact})
        release()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = rows.mapInPandas(task, "doc_id string, node long, check long, size long, rare long, end long, keys array<long>, prefix array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


_RNG_KEYS = np.random.default_rng(21).integers(0, 1 << 64, MIN_HASHES, dtype=np.uint64) | np.uint64(1)


def hits_needed(smallest, percent: int):
    return F.least(F.lit(HITS), F.ceil(smallest * percent / 100))


def fits(a_max, b_min, percent: int):
    return 100 * a_max >= percent * b_min


def prefix_length(size, percent: int):
    least = F.ceil(size * percent / 100)
    return size - least + F.least(F.lit(HITS), least)


def overlaps(sizes, a_first, a_last, b_first, b_last, a_most, b_most, percent: int):
    """Whether sets of these sizes, together, can link: 100 * x >= percent * (sizes - x) for what they share at most.
    The bound is that of the side whose prefix surely ends first."""
    most = F.when(a_last < b_first, a_most).when(b_last < a_first, b_most).otherwise(F.greatest(a_most, b_most))
    return percent * sizes <= (100 + percent) * most


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a list of ids or tokens, with a broadcast hint if it is of BROADCAST_BYTES at most."""
    return F.broadcast(df) if is_short(df) else df


def is_short(df: DataFrame) -> bool:
    most = BROADCAST_BYTES // BROADCAST_ROW
    return df.limit(most + 1).count() <= most


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is the only column of ``wanted``; null is a key like others. A long list is joined by
    a shuffle; a bit table of its hashes, of a fixed size, is broadcast before and spares that most of the other rows."""
    name = wanted.columns[0]
    exact = F.col(key).eqNullSafe(F.col("__want"))
    wanted = wanted.select(F.col(name).alias("__want"))
    if is_short(wanted):
        return df.join(F.broadcast(wanted), exact, "left_semi")

    def places(column: str) -> tuple[Column, Column]:
        h = F.xxhash64(column)
        return F.pmod(h, F.lit(SIEVE)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))

    word, bit = places("__want")
    table = wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = places(key)
    near = df.withColumns({"__at": word, "__own": bit}).join(F.broadcast(table), F.col("__at") == F.col("__word"))
    near = near.where(F.col("__bits").bitwiseAND(F.col("__own")) != 0).select(*df.columns)
    return near.join(wanted, exact, "left_semi")


def linked(inter, na, nb, percent: int) -> Column:
    return (inter > 0) & (100 * inter >= percent * (na + nb - inter))


class Join:
    """The steps of one join: the documents, the shingles' length, the least similarity in percent, and the tables."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.tables = Tables(docs.sparkSession)
        self.seed = 0

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(rows, classes): the signatures, and per node its smallest doc_id and rows."""
        while True:
            rows = self.tables.stored(signatures(self.docs, self.n, self.percent, self.seed))
            known = rows.where("node IS NOT NULL").groupBy("node")
            found = self.tables.stored(known.agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi")))
            if found.where("lo <> hi").isEmpty():
                return rows, found.select("node", "doc_id")
            self.seed += 1

    def sets(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, tokens) of ``nodes`` (node): the whole texts hashed again, which is cheaper than keeping all sets."""
        n, seed = self.n, self.seed
        wanted = self.tables.stored(classes.join(nodes.distinct(), "node", "left_semi"))
        texts = among(self.docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id").distinct())

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), CHUNK):
                    found = [shingles(t, n) for t in batch["text"].iloc[lo : lo + CHUNK]]
                    found = [s for s in found if len(s)]
                    yield pd.DataFrame({"node": np.array([digest(s, seed)[0] for s in found], dtype=np.int64), "tokens": [s.view(np.int64) for s in found]})
            release()

        found = texts.select("text").mapInPandas(task, "node long, tokens array<long>")
        # Rows that repeat an id and its text are one set; texts that only share the id are not wanted.
        return found.dropDuplicates(["node"]).join(bounded(wanted.select("node")), "node", "left_semi")

    def paired(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) with their sets ta and tb. Many pairs may have one leader b: AQE splits such a key, as
        nothing above the join asks for its rows together."""
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
        return left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")

    def compared(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b, na, nb, inter) of ``pairs`` (a, b): sizes of the whole sets and of what they share."""
        pairs = self.tables.stored(pairs)
        if pairs.isEmpty():
            return pairs.select("a", "b", *[F.lit(1).alias(c) for c in ("na", "nb", "inter")])
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes)
        both = self.paired(pairs, sets)
        return self.tables.stored(both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("inter")))

    def links(self, found: DataFrame) -> DataFrame:
        return found.where(linked(F.col("inter"), F.col("na"), F.col("nb"), self.percent)).select("a", "b")

    def grouped(self, nodes: DataFrame, compared: DataFrame) -> DataFrame:
        """(node, size, lead, d, many): each node's leader, itself if none is near, the number of differences to it and
        the number of nodes that follow it."""
        like = F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
        near = compared.withColumn("like", like).where(100 * F.col("like") >= NEAR)
        follow = near.groupBy("b").agg(F.count("*").alias("followers"))
        choice = F.struct("followers", F.col("b").alias("lead"), "like", (F.col("na") + F.col("nb") - 2 * F.col("inter")).cast("long").alias("d"))
        # As many leaders as a node has keys at most.
        of = near.join(follow, "b").groupBy(F.col("a").alias("node")).agg(F.collect_list(choice).alias("all"))
        best = F.array_max(F.transform("all", lambda x: x["like"]))
        of = of.withColumn("best", best).select("node", F.array_max(F.filter("all", lambda x: x["like"] >= F.col("best") - SLACK / 100)).alias("c"))
        nodes = nodes.select("node", "size").join(of, "node", "left")
        nodes = nodes.select("node", "size", F.coalesce("c.lead", "node").alias("lead"), F.coalesce("c.d", F.lit(0)).alias("d"))
        many = nodes.groupBy("lead").agg(F.count("*").alias("many"))
        return self.tables.stored(nodes.join(many, "lead"))

    def cells(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """(token, lead, many, node, size, most, end): the prefix tokens of the nodes that more than one group holds.
        ``most`` bounds what a node can share with the nodes of other groups whose prefix ends later: a prefix token
        that none of them holds is not in their sets either."""
        prefixes = rows.where("node IS NOT NULL").select("node", "end", "prefix").dropDuplicates(["node"])
        cells = prefixes.join(nodes.select("node", "size", "lead", "many"), "node").withColumn("token", F.explode("prefix")).drop("prefix")
        ends = cells.groupBy("token").agg(F.min("lead").alias("l0"), F.max("lead").alias("l1"))
        shared = self.tables.stored(ends.where("l0 < l1").select("token"))
        cells = among(cells, "token", shared)
        own = F.count("*").over(Window.partitionBy("node"))
        return self.tables.stored(cells.withColumn("most", F.col("size") - prefix_length(F.col("size"), self.percent) + own))

    def visits(self, cells: DataFrame) -> DataFrame:
        """(a, b): nodes and the leaders of groups, not smaller than their own, whose unions they share enough tokens with."""
        percent, c = self.percent, F.col
        union = cells.groupBy("token", "lead", "many").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("most").alias("u_most"), F.min("end").alias("first"), F.max("end").alias("last"))
        union = union.select(*[c(x).alias(f"g_{x}") for x in union.columns])
        on = (c("token") == c("g_token")) & (F.struct("many", "lead") < F.struct("g_many", "g_lead"))
        on = on & fits(c("size"), c("g_lo"), percent) & fits(c("g_hi"), c("size"), percent)
        on = on & overlaps(c("size") + c("g_lo"), c("end"), c("end"), c("g_first"), c("g_last"), c("most"), c("g_u_most"), percent)
        met = cells.join(union, on).groupBy("node", "g_lead").agg(F.count("*").alias("hits"), F.min(F.least("size", "g_lo")).alias("least"))
        return met.where(F.col("hits") >= hits_needed(F.col("least"), percent)).select(F.col("node").alias("a"), F.col("g_lead").alias("b"))

    def opened(self, nodes: DataFrame, visits: DataFrame) -> DataFrame:
        """(lead, node, size, d, lead_size) of the visits that can link with a member: a member is at most as far from
        its leader as the group's radius says."""
        p = self.percent
        radius = nodes.groupBy("lead").agg(F.max((100 + p) * F.col("d") + (100 - p) * F.col("size")).alias("radius"))
        far = visits.select(F.col("b").alias("lead"), F.col("a").alias("node"), F.col("na").alias("size"), (F.col("na") + F.col("nb") - 2 * F.col("inter")).cast("long").alias("d"), F.col("nb").alias("lead_size"))
        return far.join(radius, "lead").where((100 + p) * F.col("d") <= (100 - p) * F.col("size") + F.col("radius")).drop("radius")

    def differences(self, nodes: DataFrame, opened: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
        """(lead, node, size, d, root, lead_size, fails, diff): members and visitors of the groups that hold more than
        one component, and their differences to the leader."""
        p = self.percent
        sizes = nodes.select(F.col("node").alias("lead"), F.col("size").alias("lead_size"))
        # A leader without followers was compared with its visitors already.
        members = nodes.where("NOT (many = 1 AND node = lead)")
        opened = opened.join(members.select("lead").distinct(), "lead", "left_semi")
        members = members.join(sizes, "lead").select("lead", "node", "size", "d", "lead_size")
        all_ = members.unionByName(opened.select(*members.columns)).join(roots.withColumnRenamed("id", "node"), "node", "left")
        all_ = self.tables.stored(all_.withColumn("root", F.coalesce("root", "node")))
        mixed = all_.groupBy("lead").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("lead")
        all_ = all_.join(mixed, "lead", "left_semi").where("node <> lead")
        sets = self.sets(all_.select(F.explode(F.array("node", "lead")).alias("node")), classes)
        both = self.paired(all_.withColumnsRenamed({"node": "a", "lead": "b"}), sets)
        diff = F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta"))
        fails = (100 + p) * F.col("d") > (100 - p) * (F.col("size") + F.col("lead_size"))
        return self.tables.stored(both.select(F.col("b").alias("lead"), F.col("a").alias("node"), "size", "d", "root", "lead_size", fails.alias("fails"), diff.alias("diff")))

    def meetings(self, diffs: DataFrame) -> DataFrame:
        """(lead, node_a, node_b): nodes of different components that meet at a difference in an opened group. A token
        that is a difference is in the leader's set or not, for all of the group alike, so it needs no sign."""
        p, c = self.percent, F.col
        cells = diffs.select("lead", "node", "size", "d", "root", "lead_size", "fails", F.explode("diff").alias("token"))
        held = cells.groupBy("lead", "token").agg(F.count("*").alias("held"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").drop("r0", "r1")
        shared = cells.join(held, ["lead", "token"])
        # Differences that no other component holds come first in each node's order, so they need no place.
        own = Window.partitionBy("lead", "node")
        place_ = c("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "token"))
        # The farther node of a pair needs no more than ``far`` places, the nearer one ``close``: both bound, over all
        # partners of a size that can link, d - need + 1 with the need of ``met``.
        far = 1 + (100 - p) * c("size") / p
        close = 1 + (100 - p) * c("size") / (2 * p)
        # A node that links with the leader meets nodes that failed against it, which need more.
        met_failed = 1 + ((100 + p) * c("d") + (100 - p) * (c("size") - c("lead_size"))) / (2 * (100 + p))
        shared = shared.withColumn("place", place_).where(c("place") <= far)
        shared = self.tables.stored(shared.withColumn("close", (c("place") <= close) & (c("fails") | (c("place") < met_failed))))

        def side(x: str) -> DataFrame:
            return shared.select("lead", "token", *[c(n).alias(f"{n}_{x}") for n in ("node", "size", "d", "root", "place", "close")])

        need = F.ceil(((100 + p) * (c("d_a") + c("d_b")) - (100 - p) * (c("size_a") + c("size_b"))) / (2 * (100 + p)))
        met = (c("root_a") != c("root_b")) & (F.struct("d_a", "node_a") > F.struct("d_b", "node_b"))
        met = met & (c("place_a") <= c("d_a") - need + 1) & (c("place_b") <= c("d_b") - need + 1)
        met = met & (1 + F.least(c("d_a") - c("place_a"), c("d_b") - c("place_b")) >= need)
        a, b = side("a").drop("close_a"), side("b").where("close_b").drop("close_b")
        pairs = a.join(b, (a["lead"] == b["lead"]) & (a["token"] == b["token"]) & met).select(a["lead"], "node_a", "node_b").distinct()
        return pairs

    def inside(self, diffs: DataFrame) -> DataFrame:
        """(a, b) of the links in opened groups."""
        p, c = self.percent, F.col
        pairs = self.meetings(diffs)
        whole = diffs.select("lead", "node", "size", "d", "diff")
        for x in ("a", "b"):
            pairs = pairs.join(whole.select("lead", *[c(n).alias(f"{n}_{x}") for n in ("node", "size", "d", "diff")]), ["lead", f"node_{x}"])
        apart = c("d_a") + c("d_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
        return self.tables.stored(pairs.where((100 + p) * apart <= (100 - p) * (c("size_a") + c("size_b"))).select(c("node_a").alias("a"), c("node_b").alias("b")).distinct())

    def roots(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, classes, roots): roots are (id, root) of the linked nodes."""
        rows, classes = self.classes()
        nodes = rows.where("node IS NOT NULL").select("node", "size", "rare", "keys").dropDuplicates(["node"])
        compared = self.compared(leaders(self.tables.stored(nodes)), classes)
        links = self.links(compared)
        nodes = self.grouped(nodes, compared)
        visits = self.compared(self.visits(self.cells(rows, nodes)), classes)
        links = links.unionByName(self.links(visits))
        roots = components(links, self.tables.stored)
        opened = self.tables.stored(self.opened(nodes, visits))
        more = self.inside(self.differences(nodes, opened, roots, classes))
        return rows, classes, roots if more.isEmpty() else components(links.unionByName(more), self.tables.stored)

    def result(self) -> DataFrame:
        """A row per row: doc_id, n_shingles, component_id (the smallest doc_id of all that it is linked with, over any
        number of links; its own without links), node (its set; null without words) and root (that of its component)."""
        rows, classes, roots = self.roots()
        found = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = self.tables.stored(found)
        least = found.groupBy("root").agg(F.min("doc_id").alias("component"))
        found = found.select("node", "root").join(least, "root")
        # A class of exact copies may hold a third of the rows: AQE splits that key of this join.
        result = rows.select("doc_id", "node", "size").join(found, "node", "left")
        component = F.when(F.col("node").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
        return self.tables.close(result.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), "node", "root"))


def leaders(nodes: DataFrame) -> DataFrame:
    """(a, b): each node and, for each of its min-hash keys, the node with that key that has the fewest rare shingles."""
    keyed = nodes.select("node", "rare", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("rare", F.col("node").alias("lead"))).alias("f"), F.count("*").alias("n")).where("n > 1")
    met = keyed.join(first, "key").where("node <> f.lead")
    return met.select(F.col("node").alias("a"), F.col("f.lead").alias("b")).distinct()


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), as ``Join.result`` says."""
    return Join(docs, n, percent).result()


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates stays, that with the smallest id (rows without id
    come last).

    Five words a shingle, similarity 0.8. Documents without words are in no group and stay; of rows that repeat an id
    and a set of shingles one stays. Texts that share an id, or have none, are decided one by one.
    """
    n = 5
    work, tables = Join(docs.select("doc_id", "text"), n, 80), Tables(spark)
    found = tables.stored(work.result().where("node IS NOT NULL").select("doc_id", "node", "root"))
    seed = work.seed
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = found.groupBy("root").agg(F.min(order).alias("f"))
    gone = found.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("node") == F.col("f.node")))).select("doc_id", "node")
    gone = tables.stored(gone.distinct())
    repeated = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__unclear"))
    repeated = tables.stored(repeated)
    if repeated.isEmpty():
        return docs.join(bounded(tables.close(gone.select(F.col("doc_id").alias("__gone")))), F.col("doc_id") == F.col("__gone"), "left_anti")
    clear = docs.join(bounded(gone.select(F.col("doc_id").alias("__gone")).distinct()), F.col("doc_id") == F.col("__gone"), "left_anti")
    clear = clear.join(repeated, F.col("doc_id").eqNullSafe(F.col("__unclear")), "left_anti")
    texts = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("__unclear")), "left_semi")

    @F.pandas_udf("long")
    def node_of(text: pd.Series) -> pd.Series:
        found = [shingles(t, n) for t in text]
        return pd.Series([digest(s, seed)[0] if len(s) else None for s in found], dtype="Int64")

    named = texts.withColumn("__node", node_of("text"))
    away = gone.select(F.col("doc_id").alias("__id"), F.col("node").alias("__away"))
    kept = named.join(away, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__away")), "left_anti")
    empty = kept.where("__node IS NULL").drop("__node")
    kept = kept.where("__node IS NOT NULL").dropDuplicates(["doc_id", "__node"]).drop("__node")
    return clear.unionByName(kept).unionByName(empty)


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS inter FROM s JOIN s t ON s.shingle = t.shingle AND s.doc_id <> t.doc_id
        GROUP BY ALL) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * inter >= 85 * (na.n + nb.n - inter)),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id) c USING (doc_id)
"""
