"""Operator 5: personal data by bootstrapped contextual extraction (DataFrame functions only).

Base: e-mail addresses, IPv4 addresses, card numbers and phone numbers, by fixed patterns and checks. They
seed a bootstrap. The words next to a seed are lexical patterns ("the token before" and "the token after").
A pattern's confidence is the weight of the instances it finds over all places where its word stands in the
corpus, so common words never qualify. Identifier-like tokens are instances; an instance's weight is the
noisy-or of its patterns' confidences. A few rounds over the pattern-instance graph settle both; then tokens
whose weight is high enough are found as kind ``id``.

All expressions scan a text in linear time: no pattern retries within a run of characters. Texts are not
shuffled: only matches are, with the token on either side.

Defined results: a null or empty text has no spans and the digest of an empty string; repeated rows and
repeated or null ids are scanned row by row; in an empty table nothing is found; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vecmill.llm.common import BLANKS, cut, documents, let, upto

KINDS = ("email", "ip", "card", "phone")
TOKEN, FOUND = len(KINDS), "id"

#: The base patterns. A match can only begin where its leading run of characters does, or where the match
#: before it ended; saying so, and never giving characters back, keeps the search linear.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A blank-separated token with a digit.
TOKENS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"

ROUNDS = 3
#: Distinct seed values that a pattern needs, and the least confidence and weight that count.
SUPPORT = 5
CONFIDENCE = 0.5
ACCEPT = 0.8
#: Bytes of the patterns' words up to which they are broadcast when the corpus is counted; beyond, all words are counted.
BROADCAST_BYTES = 4 << 20
#: The blank-separated token that comes next.
NEXT = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        d = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d

    return F.aggregate(upto(F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    if KINDS[kind] == "email":
        return F.lit(True)
    if KINDS[kind] == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))
        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if KINDS[kind] == "card":
        return let(digits, lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.length(digits).between(9, 15)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """An array of (kind, i, gap, value, before, after) per match: gap is the length of the text since the last."""

    def with_gaps(found: Column, gaps: Column) -> Column:
        def row(value: Column, i: Column) -> Column:
            # Reversed, the token before is the first one, so that both are found in linear time.
            before = F.lower(F.reverse(F.regexp_extract(F.reverse(F.get(gaps, i)), NEXT, 1)))
            after = F.lower(F.regexp_extract(F.get(gaps, i + 1), NEXT, 1))
            gap = F.length(F.get(gaps, i))
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), gap.alias("gap"), value.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(found, row)

    def split(found: Column) -> Column:
        none = F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,before:string,after:string>>")
        return F.when(F.size(found) > 0, let(F.split(text, pattern), lambda gaps: with_gaps(found, gaps))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def mentions(df: DataFrame) -> DataFrame:
    """(row, doc_id, hash, kind, start, end, value, before, after) of base spans and of identifier-like tokens
    off them, and a row with a null kind per row of ``df``. Written once."""
    text = F.coalesce("text", F.lit(""))
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,before:string,after:string>>")
    lists = [F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS[0], 0)).otherwise(none)]
    for kind in range(1, TOKEN):
        lists.append(F.when(digit, matches(text, PATTERNS[kind], kind)).otherwise(none))
    lists.append(F.when(digit, matches(text, TOKENS, TOKEN)).otherwise(none))
    mark = F.array(F.lit(None).cast("struct<kind:int,i:int,gap:int,value:string,before:string,after:string>"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("hash"), F.concat(mark, *lists).alias("m"))
    rows = rows.select("row", "doc_id", "hash", F.explode_outer("m").alias("m")).select("row", "doc_id", "hash", "m.*")
    # One exchange of matches by row; all that follows finds a row's matches together.
    rows = rows.repartition("row")
    at = Window.partitionBy("row", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(at))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    # A token's outer punctuation is not part of it.
    is_token = F.col("kind") == TOKEN
    lead = F.length(F.regexp_extract("value", r"""^[("'\[{<]*""", 0))
    core = F.regexp_extract("value", r"""^[("'\[{<]*(.*?)[)"'\]}>.,;:!?]*$""", 1)
    rows = rows.withColumn("start", F.when(is_token, F.col("start") + lead).otherwise(F.col("start")))
    rows = rows.withColumn("value", F.when(is_token, core).otherwise(F.col("value")))
    rows = rows.withColumn("end", F.when(is_token, F.col("start") + F.length("value")).otherwise(F.col("end")))
    ok = F.col("kind").isNull()
    for kind in range(TOKEN):
        ok = ok | ((F.col("kind") == kind) & valid(kind, F.col("value")))
    ok = ok | (is_token & (F.length("value") >= 6) & (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 4))
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    whole = Window.partitionBy("row").orderBy("start", "kind")
    base_end, base_start = F.when(F.col("kind") < TOKEN, F.col("end")), F.when(F.col("kind") < TOKEN, F.col("start"))
    rows = rows.withColumns(
        {
            "prior": F.max(base_end).over(whole.rowsBetween(Window.unboundedPreceding, 0)),
            "later": F.min(base_start).over(whole.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    clear = (F.coalesce("prior", F.lit(0)) <= F.col("start")) & (F.coalesce("later", F.col("end")) >= F.col("end"))
    rows = rows.where(F.col("kind").isNull() | (F.col("kind") < TOKEN) | clear)
    return cut(rows.select("row", "doc_id", "hash", "kind", "start", "end", "value", "before", "after"))


def graph(found: DataFrame) -> DataFrame:
    """(pattern, value, seed, n): how often a pattern's word stands next to an instance."""
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col("before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("after").alias("word")))
    edges = found.where("kind IS NOT NULL").select("value", (F.col("kind") < TOKEN).alias("seed"), F.explode(sides).alias("p"))
    edges = edges.where("p.word <> ''").select(F.col("p.side").alias("side"), F.col("p.word").alias("word"), "value", "seed")
    edges = edges.groupBy("side", "word", "value", "seed").agg(F.count("*").alias("n"))
    rich = edges.where("seed").groupBy("side", "word").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    return cut(edges.join(rich.drop("seeds"), ["side", "word"]))


def places(df: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, places): in how many places of the corpus each pattern's word stands."""
    words = edges.select("word").distinct()
    every = df.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), BLANKS)).alias("word"))
    size = words.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return every.join(F.broadcast(words), "word").groupBy("word").agg(F.count("*").alias("places"))
    return every.groupBy("word").agg(F.count("*").alias("places")).join(words, "word")


def bootstrap(df: DataFrame, found: DataFrame) -> DataFrame:
    """(side, word, confidence) of the patterns that qualify."""
    edges = graph(found)
    spark = df.sparkSession
    if edges.isEmpty():
        return spark.createDataFrame([], "side string, word string, confidence double")
    counts = cut(places(df, edges))
    edges = cut(edges.join(counts, "word"))
    weights = None
    for _ in range(ROUNDS):
        scored = edges if weights is None else edges.join(weights, "value", "left")
        weight = F.when(F.col("seed"), 1.0).otherwise(F.lit(0.0) if weights is None else F.coalesce("weight", F.lit(0.0)))
        total = scored.groupBy("side", "word").agg(F.sum(weight * F.col("n")).alias("w"), F.max("places").alias("places"))
        patterns = total.select("side", "word", F.least(F.lit(1.0), F.round(F.col("w") / F.col("places"), 9)).alias("confidence"))
        patterns = cut(patterns.where(F.col("confidence") >= CONFIDENCE))
        misses = edges.where("NOT seed").join(patterns, ["side", "word"])
        miss = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        weights = cut(misses.groupBy("value").agg((1 - F.exp(miss)).alias("weight")))
    return patterns


def find(df: DataFrame) -> DataFrame:
    """(row, doc_id, hash, spans) per row of ``df`` (doc_id, text): spans are (start, kind, end), base kinds by
    number and found ones as TOKEN, in order."""
    found = mentions(df)
    patterns = bootstrap(df, found)
    miss = F.lit(0.0)
    joined = found
    for side in ("before", "after"):
        own = patterns.where(F.col("side") == side).select(F.col("word").alias(side), F.col("confidence").alias(f"c_{side}"))
        joined = joined.join(own, side, "left")
        miss = miss + F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce(f"c_{side}", F.lit(0.0))))
    keep = (F.col("kind") < TOKEN) | (1 - F.exp(miss) >= ACCEPT)
    span = F.when(F.col("kind").isNotNull() & keep, F.struct(F.col("start"), F.col("kind"), F.col("end")))
    return joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.sort_array(F.collect_list(span)).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir).select("doc_id", "text"))
    of = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < TOKEN)
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span's characters replaced by its kind in angle brackets; overlapping spans are one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, FOUND)])
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] - acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), skip.cast("int")), F.get(names, s["kind"]))
        out = F.when(skip >= 0, F.concat(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"].cast("long")).alias("at"), out.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, state, step, end)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced by the name of its kind; every document stays. ``docs`` may have any
    columns besides doc_id, text and n_chars."""
    spans = find(docs.select("doc_id", "text")).where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["doc_id", "hash"]).select(F.col("doc_id").alias("id"), "hash", "spans")
    # The row is one column, so that its names clash with none.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("h"))
    joined = keyed.join(spans, F.col("row.doc_id").eqNullSafe(spans["id"]) & (keyed["h"] == spans["hash"]), "left")
    found = F.col("spans").isNotNull()
    new = joined.withColumn("new", F.when(found, redacted(F.col("row.text"), F.col("spans"))))
    changed = {"text": F.when(found, F.col("new")).otherwise(F.col("row.text")), "n_chars": F.when(found, F.length("new").cast("long")).otherwise(F.col("row.n_chars"))}
    return new.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
