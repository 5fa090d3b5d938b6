"""Operator 9: SentencePiece encoding and decoding as a relational lattice.

Text is cut into words (a run of blanks and what follows). Distinct words are encoded once: their bounded-length
substrings are exploded and equi-joined to the piece table, the matches are the edges of the word's lattice, grouped
by word, and a higher-order ``aggregate`` folds each lattice into a path. The paths are then put together to each
document's list of ids, and every list is decoded to prove the round trip.

The fold depends on the model. For unigram models it is Viterbi: the path with the best total score. A BPE model
encodes to another path: pieces merge best score first. Its fold takes the edges once, in the order in which their
merges happen: an edge is taken if both its ends are still bounds, and removes the bounds inside. That order is a
property of the pieces, found once per model: while the ends of a piece are bounds nothing outside touches it, so what
happens inside is what happens to the piece alone. A piece that alone does not become one symbol never merges; one
that needs a worse piece first merges right after it.

So are the most frequent words, by bounded summaries of all tasks: some nine tenths of all places. Their ids are sent to
every task. The other words stand in so few places that moving them costs more than encoding them where they are: each
task makes the lattices of its own in NumPy, by the same steps (substrings, a hash join with the pieces, edges
sorted by word, the same fold over all words at once). Documents and ids are not shuffled. Which words are taken for
frequent fixes costs only. Words over LONG characters, for which no 64-bit mask has room, are encoded in plain Python.

Decoding looks ids up among the pieces, and is applied to every document's list.

Defined results: null and empty texts have no words and no tokens, and round-trip; characters that are not
pieces become their UTF-8 bytes; rows that repeat each other are encoded one by one; an empty table gives no rows;
other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vecmill.llm.common import documents, let, release, upto

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Of the hashes of texts: an odd base, and a number for each byte.
BASE = 0x9F8B6C4D2E1A5073
BYTES = np.random.default_rng(23).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Word length up to which the boundaries of a word fit a 64-bit mask.
LONG = 60
#: Words kept of the summaries, of each task's and of all. They are LONG characters at most, so all of them and their
#: ids take some megabytes, and 40 MB at the very most.
FREQUENT_LOCAL = 1 << 15
FREQUENT = 1 << 16
#: Rows and about bytes of text of a batch that are put together at a time.
TASK_ROWS = 512
TASK_BYTES = 1 << 18
BLANK = ord(" ")


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[tuple[str, int, float]]
    bytes_: list[int]
    unknown: int
    bpe: bool

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Each piece's place by score, best first, from 0; pieces of equal score share one."""
        place = {score: r for r, score in enumerate(sorted({x for _, _, x in self.pieces}, reverse=True))}
        return {p: place[score] for p, _, score in self.pieces}

    @cached_property
    def moments(self) -> dict[str, tuple[int, int, int]]:
        """When a longer piece of a BPE model merges: (rank, offset, step). That is its own rank, unless one of its halves
        merges with it or later: then a step after that half, whose rank and place within the piece count. Of equal ranks
        the leftmost comes first. Pieces that do not become one symbol by themselves are left out."""
        ranks, found = self.ranks, {}
        for piece in sorted(ranks, key=len):
            if len(piece) < 2:
                continue
            # The halves that the merges within the piece leave, if it becomes one.
            parts = list(piece)
            while len(parts) > 2:
                pairs = [(ranks[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in ranks]
                if not pairs:
                    break
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 2:
                continue
            at, halves = 0, []
            for part in parts:
                if len(part) > 1:
                    rank, offset, step = found[part]
                    halves.append((rank, offset + at, step + 1))
                at += len(part)
            found[piece] = max([*halves, (ranks[piece], 0, 0)])
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, cost), or (piece, id, rank, offset, step): as large as the vocabulary, so it can be broadcast. For BPE models longer
        pieces that never merge are left out, and single characters have rank -1."""
        if not self.bpe:
            return spark.createDataFrame([(p, i, -s) for p, i, s in self.pieces], "piece string, id int, cost double")
        rows = [(p, i, *(self.moments[p] if len(p) > 1 else (-1, 0, 0))) for p, i, _ in self.pieces if len(p) == 1 or p in self.moments]
        if any(step >= 1 << STEP_BITS for *_, step in rows):
            raise ValueError("pieces that merge in so many steps are not supported")
        return spark.createDataFrame(rows, "piece string, id int, rank int, offset int, step int")


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models that keep texts as they are, with a leading blank, are supported")
    kinds = pb.ModelProto.SentencePiece
    usable = (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)
    pieces = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type in usable]
    if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p, _, _ in pieces):
        raise ValueError("pieces that span words are not supported")
    own = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
    bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
    if len(model.pieces) >= 1 << 18 or any(len(p) > LONG for p, _, _ in pieces):
        raise ValueError("models of 2^18 pieces or more, or with pieces over LONG characters, are not supported")
    return Vocabulary(pieces, [own[b] for b in range(256)] if len(own) == 256 else [], unknown, bpe)


def normalized(text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise("")


def words_of(text: Column) -> Column:
    """The words of a text, line breaks apart; joined together they are the normalized text."""
    pattern = rf"\n|{SPACE}++[^{SPACE}\n]*+|[^{SPACE}\n]++"
    return F.regexp_extract_all(normalized(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


#: Bits of an edge of a BPE lattice, as one number: when it merges (rank, place, step), its bounds and its id.
STEP_BITS, BOUND_BITS, ID_BITS = 4, 6, 20


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, edges) of ``words`` (word), of LONG characters at most: the pieces that match word[s:e], sorted. For
    unigram models an edge is (e, s, cost, id), for BPE models a number that rises in the order of the merges.
    ``words`` is not shuffled if it is partitioned by word."""
    n = F.length("word")
    table = F.broadcast(vocabulary.table(words.sparkSession))
    starts = words.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), n - 1)))
    most = F.least(F.lit(vocabulary.longest), F.col("n") - F.col("s"))
    parts = starts.withColumn("l", F.explode(F.sequence(F.lit(1), most)))
    met = parts.join(table, F.substring(F.col("word"), F.col("s") + 1, F.col("l")) == F.col("piece"), "left")
    # Words in which no piece is found have no edges, but stay.
    met = met.where(F.col("id").isNotNull() | ((F.col("s") == 0) & (F.col("l") == 1)))
    s, e, id_ = F.col("s"), F.col("s") + F.col("l"), F.col("id")
    if vocabulary.bpe:
        edge = packed((F.col("rank") + 1, 18), (s + F.col("offset"), BOUND_BITS), (F.col("step"), STEP_BITS), (s, BOUND_BITS), (e, BOUND_BITS), (id_, ID_BITS))
    else:
        edge = F.struct(e.alias("e"), s.alias("s"), "cost", "id")
    found = met.select("word", F.when(id_.isNotNull(), edge).alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return found.select("word", n.alias("n"), "edges")


def packed(*fields: tuple[Column, int]) -> Column:
    """One long that holds the numbers, each of so many bits, the first one highest."""
    out = F.lit(0).cast("long")
    for value, bits in fields:
        out = F.shiftleft(out, bits).bitwiseOR(value.cast("long"))
    return out


def field(edge: Column, low: int, bits: int) -> Column:
    return F.shiftright(edge, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def span(edge: Column) -> tuple[Column, Column]:
    return field(edge, ID_BITS + BOUND_BITS, BOUND_BITS), field(edge, ID_BITS, BOUND_BITS)


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def ends(edge: Column) -> tuple[Column, Column]:
    """Masks of an edge's two bounds and of those inside."""
    s, e = span(edge)
    return bit(s) + bit(e), (bit(e) - 1).bitwiseAND(-bit(s + 1))


def merged(n: Column, edges: Column) -> Column:
    """BPE: the bounds of the symbols, as a mask, after all merges: an edge whose ends are bounds removes those inside.
    Single characters, which come first, remove none."""

    def step(mask: Column, edge: Column) -> Column:
        outer, inner = ends(edge)
        return F.when(mask.bitwiseAND(outer) == outer, mask.bitwiseAND(F.bitwise_not(inner))).otherwise(mask)

    return F.aggregate(edges, bit(n + 1) - 1, step)


def taken(edges: Column, mask: Column) -> Column:
    """The edges between neighbouring bounds of the mask, as s * 2^ID_BITS + id, in order."""

    def kept(edge: Column) -> Column:
        outer, inner = ends(edge)
        return (mask.bitwiseAND(outer) == outer) & (mask.bitwiseAND(inner) == 0)

    id_ = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
    return F.sort_array(F.transform(F.filter(edges, kept), lambda x: F.shiftleft(span(x)[0].cast("long"), ID_BITS) + id_(x)))


def bounds_of_mask(n: Column, mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def bytes_of(text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a character that is no piece: its bytes', or the unknown id."""
    if not vocabulary.bytes_:
        return F.array(F.lit(vocabulary.unknown))
    table = F.array(*[F.lit(i) for i in vocabulary.bytes_])
    return let(F.hex(F.encode(text, "UTF-8")), lambda h: F.transform(upto((F.length(h) / 2).cast("int")), lambda k: F.get(table, F.conv(F.substring(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))))


def merged_ids(word: Column, n: Column, edges: Column, vocabulary: Vocabulary) -> Column:
    """BPE: the ids of a word. Only a character that is no piece needs more than the edges taken."""
    id_ = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long")).cast("int")

    def slow(found: Column, mask: Column) -> Column:
        def one(s: Column) -> Column:
            own = F.get(F.filter(found, lambda x: F.shiftright(x, ID_BITS) == s), 0)
            return F.when(own.isNotNull(), F.array(id_(own))).otherwise(bytes_of(F.substring(word, s + 1, F.lit(1)), vocabulary))

        starts = F.filter(bounds_of_mask(n, mask), lambda i: i < n)
        return F.flatten(F.transform(starts, one))

    def put(mask: Column) -> Column:
        return let(taken(edges, mask), lambda found: F.when(F.size(found) == F.bit_count(mask) - 1, F.transform(found, id_)).otherwise(slow(found, mask)))

    return let(merged(n, edges), put)


def viterbi(n: Column, edges: Column, unknown_cost: float) -> Column:
    """Unigram: the edges (e, s, cost, id) of the cheapest path, in order. A character may be an edge of its own, without
    id. Edges come by their end, so one pass knows the best way to each place; of equal ways that of the longest last edge."""
    cell = "struct<cost:double,s:int,id:int>"
    plain = F.transform(F.sequence(F.lit(1), n), lambda e: F.struct(e.alias("e"), (e - 1).alias("s"), F.lit(unknown_cost).alias("cost"), F.lit(None).cast("int").alias("id")))

    def step(acc: Column, x: Column) -> Column:
        way = F.struct((F.get(acc, x["s"])["cost"] + x["cost"]).alias("cost"), x["s"].alias("s"), x["id"].alias("id")).cast(cell)
        grown = F.concat(acc, F.array(way))
        better = F.concat(F.slice(acc, F.lit(1), x["e"]), F.array(way))
        return F.when(F.size(acc) == x["e"], grown).when(way["cost"] < F.get(acc, x["e"])["cost"], better).otherwise(acc)

    def back(cells: Column) -> Column:
        state = F.struct(n.alias("at"), F.array().cast("array<struct<e:int,s:int,id:int>>").alias("path"))

        def hop(acc: Column, _: Column) -> Column:
            here = F.get(cells, acc["at"])
            edge = F.struct(acc["at"].alias("e"), here["s"].alias("s"), here["id"].alias("id"))
            return F.when(acc["at"] > 0, F.struct(here["s"].alias("at"), F.concat(F.array(edge), acc["path"]).alias("path"))).otherwise(acc)

        return F.aggregate(upto(n), state, hop, lambda acc: acc["path"])

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("s"), F.lit(None).cast("int").alias("id")).cast(cell))
    return let(F.aggregate(F.array_sort(F.concat(edges, plain)), start, step), back)


def path_ids(word: Column, path: Column, vocabulary: Vocabulary) -> Column:
    """Unigram: the ids along a path."""
    return F.flatten(F.transform(path, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(bytes_of(F.substring(word, x["s"] + 1, x["e"] - x["s"]), vocabulary))))


def merge_long(word: str, ranks: dict[str, tuple[float, int]], bytes_: list[int], unknown: int) -> list[int]:
    """BPE of one word with a heap of mergeable pairs; time n log n in its length."""
    text: list[str | None] = list(word)
    left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(text) and (pair := text[i] + text[j]) in ranks:
            heapq.heappush(heap, (-ranks[pair][0], i, j, pair))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, pair = heapq.heappop(heap)
        if text[i] is None or text[j] is None or right[i] != j or text[i] + text[j] != pair:
            continue
        text[i], text[j], right[i] = pair, None, right[j]
        if right[i] < len(text):
            left[right[i]] = i
        offer(left[i], i)
        offer(i, right[i])
    out: list[int] = []
    for t in text:
        if t is not None:
            out += [ranks[t][1]] if t in ranks else ([bytes_[b] for b in t.encode()] if bytes_ else [unknown])
    return out


def viterbi_long(word: str, costs: dict[str, tuple[float, int]], longest: int, unknown_cost: float, bytes_: list[int], unknown: int) -> list[int]:
    """Unigram: the ids of the cheapest path of one word; time in step with its length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        ways = [(best[s][0] + (costs[p][0] if (p := word[s:e]) in costs else unknown_cost), s) for s in range(max(0, e - longest), e) if s == e - 1 or word[s:e] in costs]
        best.append(min(ways))
    out, e = [], len(word)
    while e:
        s = best[e][1]
        p = word[s:e]
        out.append([costs[p][1]] if p in costs else ([bytes_[b] for b in p.encode()] if bytes_ else [unknown]))
        e = s
    return [i for part in reversed(out) for i in part]


def worst_cost(vocabulary: Vocabulary) -> float:
    return max((-s for _, _, s in vocabulary.pieces), default=0.0) + 10.0


def encode_short(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, ids) of distinct ``words`` (word) of LONG characters at most; not shuffled if partitioned by word."""
    grid = lattice(words.select("word"), vocabulary)
    word, n, edges = F.col("word"), F.col("n"), F.col("edges")
    if vocabulary.bpe:
        return grid.select("word", merged_ids(word, n, edges, vocabulary).alias("ids"))
    return grid.select("word", path_ids(word, viterbi(n, edges, worst_cost(vocabulary)), vocabulary).alias("ids"))


def long_encoder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    """The ids of one word, in plain Python."""
    bytes_, unknown, longest, worst = vocabulary.bytes_, vocabulary.unknown, vocabulary.longest, worst_cost(vocabulary)
    if vocabulary.bpe:
        ranks = {p: (x, i) for p, i, x in vocabulary.pieces}
        return lambda w: merge_long(w, ranks, bytes_, unknown)
    costs = {p: (-x, i) for p, i, x in vocabulary.pieces}
    return lambda w: viterbi_long(w, costs, longest, worst, bytes_, unknown)


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, ids) of distinct ``words`` (word) of any length."""
    one = long_encoder(vocabulary)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[one(w) for w in batch["word"]])

    long_ = words.where(F.length("word") > LONG).select("word").mapInPandas(task, "word string, ids array<int>")
    return encode_short(words.where(F.length("word") <= LONG), vocabulary).unionByName(long_)


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' base and of its inverse modulo 2^64, of ``size`` exponents."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Spans:
    """Hashes of any spans of a text of bytes, each in constant time."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = powers(1 << max(16, len(raw).bit_length()))
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(BYTES[raw] * power[: len(raw)], out=self.total[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


class Coder:
    """Encodes words in NumPy; blanks stand for themselves. Pieces are found by 64-bit hashes, all different: that no
    other text is taken for a piece is proven by decoding every document."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.one = vocabulary, long_encoder(vocabulary)
        raw = [p.replace(SPACE, " ").encode() for p, _, _ in vocabulary.pieces]
        ends = np.cumsum([0, *map(len, raw)])
        hashes = Spans(np.frombuffer(b"".join(raw), dtype=np.uint8)).hashes(ends[:-1], ends[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        names = [vocabulary.pieces[i] for i in order]
        self.ids = np.array([i for _, i, _ in names], dtype=np.int32)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.bytes = np.array(vocabulary.bytes_, dtype=np.int32)
        if vocabulary.bpe:
            moments = vocabulary.moments
            when = [moments.get(p, (-1, 0, 0)) for p, _, _ in names]
            self.rank, self.offset, self.step = (np.array([w[k] for w in when], dtype=np.int64) for k in range(3))
        else:
            self.cost = np.array([-x for _, _, x in names])

    def pieces(self, h: np.ndarray) -> np.ndarray:
        """The place of the piece with each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == h[maybe], at, -1)
        return out

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin and end (n + 1 places), and the ids."""
        if not len(words) or not len(self.hashes):
            lists = [np.array(self.one(w), dtype=np.int32) for w in words.to_pylist()]
            return np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), np.concatenate([np.empty(0, np.int32), *lists])
        words = pa.concat_arrays([words.cast(pa.string())])
        begin = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        spans = Spans(raw)
        # Characters: their first bytes, and the end; the first of each word, and how many it has.
        char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first = np.searchsorted(char, begin)
        n = np.diff(first)
        word = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(word)) - first[word]
        short = n <= LONG
        left = np.where(short[word], n[word] - at, 0)
        mask = self.best_path(spans, char, first, n, word, at, left, short) if not self.v.bpe else self.merges(spans, char, n, word, at, left, short)
        # A token begins at each bound but the last; a long word is one token for now.
        token = np.flatnonzero(np.where(short[word], (mask[word] >> at.astype(np.uint64)) & np.uint64(1) == 1, at == 0))
        b, e = char[token], char[np.append(token[1:], len(word))]
        piece = self.pieces(spans.hashes(b, e))
        own = short[word[token]] & (piece >= 0)
        length = np.where(own, 1, (e - b) if len(self.bytes) else 1)
        far = np.flatnonzero(~short[word[token]])
        lists = [np.array(self.one(bytes(raw[b[i] : e[i]]).decode().replace(" ", SPACE)), dtype=np.int32) for i in far]
        length[far] = [len(x) for x in lists]
        place = np.concatenate(([0], np.cumsum(length)))
        out = np.full(place[-1], self.v.unknown, dtype=np.int32)
        out[place[:-1][own]] = self.ids[piece[own]]
        if len(self.bytes):
            other = np.flatnonzero(~own & short[word[token]])
            inside = np.arange(length[other].sum()) - np.repeat(np.cumsum(length[other]) - length[other], length[other])
            out[np.repeat(place[other], length[other]) + inside] = self.bytes[raw[np.repeat(b[other], length[other]) + inside]]
        for i, own_ids in zip(far, lists, strict=True):
            out[place[i] : place[i + 1]] = own_ids
        return place[np.searchsorted(token, first)], out

    def merges(self, spans: Spans, char: np.ndarray, n: np.ndarray, word: np.ndarray, at: np.ndarray, left: np.ndarray, short: np.ndarray) -> np.ndarray:
        """BPE: each word's bounds as a mask, by the fold that ``merged`` makes."""
        found, k = [], np.flatnonzero(left > 1)
        for size in range(2, self.v.longest + 1):
            k = k[left[k] >= size]
            piece = self.pieces(spans.hashes(char[k], char[k + size]))
            ok = piece >= 0
            ok[ok] = self.rank[piece[ok]] >= 0
            p = piece[ok]
            s = at[k[ok]]
            when = (self.rank[p] << BOUND_BITS + STEP_BITS) | (s + self.offset[p] << STEP_BITS) | self.step[p]
            found.append(np.stack([word[k[ok]], when, s, s + size]))
        w, when, s, e = np.concatenate(found, axis=1) if found else np.empty((4, 0), dtype=np.int64)
        order = np.lexsort((when, w))
        w, s, e = w[order], s[order].astype(np.uint64), e[order].astype(np.uint64)
        one = np.uint64(1)
        outer, inner = (one << s) | (one << e), ((one << e) - one) & ~((one << s + one) - one)
        mask = (one << np.where(short, n + 1, 0).astype(np.uint64)) - one
        # The j-th edges of all words at a time.
        begin = np.searchsorted(w, np.arange(len(n)))
        number = np.diff(np.append(begin, len(w)))
        active = np.argsort(-number, kind="stable")
        for j in range(int(number.max(initial=0))):
            active = active[: np.searchsorted(-number[active], -j)]
            edge = begin[active] + j
            now = mask[active]
            mask[active] = np.where(now & outer[edge] == outer[edge], now & ~inner[edge], now)
        return mask

    def best_path(self, spans: Spans, char: np.ndarray, first: np.ndarray, n: np.ndarray, word: np.ndarray, at: np.ndarray, left: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Unigram: each word's bounds as a mask, by the fold that ``viterbi`` makes."""
        costs = []
        for size in range(1, self.v.longest + 1):
            cost = np.full(len(word) + 1, np.inf if size > 1 else worst_cost(self.v))
            k = np.flatnonzero(left >= size)
            piece = self.pieces(spans.hashes(char[k], char[k + size]))
            cost[k[piece >= 0]] = self.cost[piece[piece >= 0]]
            costs.append(cost)
        top = int(n[short].max(initial=0))
        best, back = np.full((len(n), top + 1), np.inf), np.ones((len(n), top + 1), dtype=np.int64)
        best[:, 0] = 0
        for e in range(1, top + 1):
            who = np.flatnonzero(short & (n >= e))
            for size in range(min(self.v.longest, e), 0, -1):
                way = best[who, e - size] + costs[size - 1][first[who] + e - size]
                better = way < best[who, e]
                best[who[better], e], back[who[better], e] = way[better], size
        mask, place = np.zeros(len(n), dtype=np.uint64), np.where(short, n, 0)
        for _ in range(top + 1):
            mask |= np.uint64(1) << place.astype(np.uint64)
            place = np.maximum(0, place - np.where(place > 0, back[np.arange(len(n)), place], 0))
        return mask


def decode(df: DataFrame, vocabulary: Vocabulary, key: str, ids: str = "ids") -> DataFrame:
    """(key, text): the normalized text of each id list."""
    return decoded(df.select(key, F.col(ids).alias("ids")), vocabulary).select(key, "text")


def decoded(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``df`` with ``text``, the normalized text of its ``ids``. The surfaces, as many as the vocabulary has pieces, go
    to every task; an id without a surface stands for nothing."""
    surface = {**{i: p.encode() for p, i, _ in vocabulary.pieces}, **{i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}}
    table = df.sparkSession.sparkContext.broadcast([surface.get(i, b"") for i in range(max(surface, default=-1) + 2)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(table.value, pa.binary())
        for batch in batches:
            for part in parts_of(batch, "ids"):
                at, flat = listed(part.column("ids"))
                flat = np.where((flat >= 0) & (flat < len(known)), flat, len(known) - 1)
                parts = known.take(pa.array(flat))
                ends = np.frombuffer(parts.buffers()[1], dtype=np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, dtype=np.int32)
                raw = (parts.buffers()[2] or b"") if len(flat) else b""
                raw, at = memoryview(raw), ends[at]
                texts = [bytes(raw[i:j]).decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])
        release()

    return df.mapInArrow(task, StructType([*df.schema.fields, StructField("text", StringType())]))


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins and ends (n + 1 places), and the lists' values, from 0. Null lists are empty."""
    flat = column.flatten()
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(lengths))), flat.to_numpy(zero_copy_only=False) if pa.types.is_integer(flat.type) else flat


def parts_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of TASK_ROWS rows and about TASK_BYTES of ``column``, texts or ids, at most, but of a row at least."""
    values = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    total, lo = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TASK_BYTES, side="right"))
        hi = min(max(hi, lo + 1), lo + TASK_ROWS, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, end to end, blanks in place of their signs; where the words of each text begin (n + 1
    places); and where its bytes do. Like ``words_of``."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    texts = pa.concat_arrays([texts])
    text_at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[text_at[0] : text_at[-1]]
    text_at = text_at - text_at[0]
    blank, line = raw == BLANK, raw == 10
    start = line.copy()
    start[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    start[text_at[:-1][np.diff(text_at) > 0]] = True
    begin = np.flatnonzero(start)
    offsets = np.append(begin, len(raw)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))
    return words, np.searchsorted(begin, text_at), text_at


def frequent_words(df: DataFrame) -> DataFrame:
    """(word): the most frequent words of ``df`` (text), from a bounded summary of every task."""

    def top(words: pa.Table) -> pa.Table:
        words = words.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        return words.take(pc.select_k_unstable(words, FREQUENT_LOCAL, [("n", "descending")])) if len(words) > FREQUENT_LOCAL else words

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for part in parts_of(batch, "text"):
                found = pc.value_counts(cut_words(part.column("text"))[0])
                found = pa.table({"word": found.field("values"), "n": found.field("counts")})
                found = found.filter(pc.less_equal(pc.utf8_length(found["word"]), LONG))
                held = pa.concat_tables([held, found.set_column(0, "word", found["word"].cast(pa.string()))])
                if len(held) > 8 * FREQUENT_LOCAL:
                    held = top(held)
        held = top(held)
        held = held.filter(pc.greater(held["n"], 1))
        signs = pc.replace_substring(held["word"], " ", SPACE)
        yield from held.set_column(0, "word", signs).combine_chunks().to_batches()
        release()

    found = df.select("text").mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")


def assembled(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, mark, n_words, ids) per row of ``df`` (doc_id, text); ``mark`` is the MD5 of the normalized text. Each row is
    encoded within its task."""
    few = encode_short(frequent_words(df).repartition(8, "word"), vocabulary).toArrow()
    context = df.sparkSession.sparkContext
    known_words = pc.replace_substring(few.column("word").combine_chunks(), SPACE, " ")
    table = context.broadcast((known_words, *listed(few.column("ids").combine_chunks()), vocabulary))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_begin, known_ids, own = table.value
        coder = Coder(own)
        for batch in batches:
            for part in parts_of(batch, "text"):
                words, at, _ = cut_words(part.column("text"))
                coded = pc.dictionary_encode(words)
                distinct, which = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)
                place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                other = np.flatnonzero(place < 0)
                begin, ids = coder.encode(distinct.take(pa.array(other)))
                first, last = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
                old = place >= 0
                first[old], last[old] = known_begin[place[old]], known_begin[place[old] + 1]
                first[other], last[other] = len(known_ids) + begin[:-1], len(known_ids) + begin[1:]
                values = np.concatenate((known_ids.astype(np.int32), ids))
                length = (last - first)[which]
                ends = np.concatenate(([0], np.cumsum(length)))
                out = values[np.repeat(first[which] - ends[:-1], length) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(np.diff(at), pa.int64()), lists], names=["doc_id", "mark", "n_words", "ids"])
        release()

    mark = F.unhex(F.md5(F.encode(normalized(F.coalesce(F.col("text"), F.lit(""))), "UTF-8")))
    asked = df.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    return asked.mapInArrow(task, "doc_id long, mark binary, n_words long, ids array<int>")


def encode(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) per row of ``df`` (doc_id, text)."""
    return assembled(df, vocabulary).select("doc_id", "ids")


def digest(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): its ids, n_words, n_tokens, ids_digest (of the ids in their places) and
    round_trip: whether the ids decode to the document's normalized text (by its MD5)."""
    found = decoded(assembled(df, vocabulary), vocabulary)
    same = F.unhex(F.md5(F.encode("text", "UTF-8"))) == F.col("mark")
    return found.select(
        "doc_id", "n_words", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_digest"),
        F.coalesce(same & F.col("ids").isNotNull(), F.lit(False)).alias("round_trip"), "ids",
    )


def op9_pieces(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return digest(documents(spark, sf_dir).select("doc_id", "text"), load(model))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last; what op9 returns, over the stage's own input."""
    return digest(docs.select("doc_id", "text"), load())
