"""Operator 7: quality rules as a short-circuit cascade (DataFrame functions only).

Each rule rejects a text by a statistic of the whole text. On a small random sample every rule's cost and
selectivity is measured; the rules then run in the order of rejection per cost, so most bad texts are
settled by cheap rules and the costly ones see the rest. The order never changes a verdict.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows and repeated or
null ids are judged row by row; an empty table gives no rows (no rule then rejects, and all cost nothing); columns other
than the id and the text are not looked at, and may have any names.
"""

from __future__ import annotations

import random
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecmill.llm.common import BLANKS, documents, let, upto, word_list

WINDOW = 5
#: The sample that costs are measured on: so many rows, of so many files, each rule so often.
SAMPLE_ROWS = 2_048
SAMPLE_FILES = 16
REPEATS = 3
SEED = 7


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Z]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def window_hashes(words: Column, n: int = WINDOW) -> Column:
    """A 64-bit hash of each run of n words."""
    return let(words, lambda w: F.transform(upto(F.size(w) - (n - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)))))


def n_repeat_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, its first place included.

    Texts without a repeated window, nearly all, are settled by one hashed pass. For the others the windows
    are sorted, so the time is n log n in the length of the text even if every window repeats.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            upto(F.size(starts)),
            F.lit(0),
            lambda acc, k: acc + F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(n))),
        )

    def repeated(pairs: Column) -> Column:
        same = lambda k: F.get(pairs, k)["h"] == F.get(pairs, k + 1)["h"]
        kept = F.filter(
            upto(F.size(pairs)),
            lambda k: F.coalesce(same(k), F.lit(False)) | F.when(k > 0, same(k - 1)).otherwise(False),
        )
        return let(F.sort_array(F.transform(kept, lambda k: F.get(pairs, k)["i"])), covered)

    def counted(given: Column) -> Column:
        pairs = F.sort_array(F.transform(given, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(given)) == F.size(given), F.lit(0)).otherwise(let(pairs, repeated))

    return let(hashes, counted).cast("long")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a column of a frame with ``text``, ``words``, ``lines`` and ``hashes``; never null."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rule set."""
    c = F.col
    own = {
        "n_words": F.size(c("words")).cast("long"),
        "word_chars": word_chars(c("words")),
        "n_symbols": n_symbols(c("text")),
        "n_capitals": n_capitals(c("text")),
        "n_lines": F.size(c("lines")).cast("long"),
        "n_dup_lines": n_dup_lines(c("lines")),
        "n_repeat_words": n_repeat_words(c("hashes")),
    }
    s = own.__getitem__
    return [
        Rule("few_words", s("n_words") < 10),
        Rule("repeated_windows", 100 * s("n_repeat_words") > 20 * s("n_words")),
        Rule("symbols", 100 * s("n_symbols") > 10 * s("word_chars")),
        Rule("repeated_lines", 2 * s("n_dup_lines") > s("n_lines")),
        Rule("capitals", 2 * s("n_capitals") > s("word_chars")),
    ]


def prepared(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds what the rules read: words, lines and window hashes.

    Catalyst may write these into a rule that it pushes down; the rules bind each to a lambda variable, so
    that it is still computed once a row.
    """
    df = df.withColumns({"words": word_list(F.col(text_col)), "lines": worded_lines(F.col(text_col))})
    return df.withColumn("hashes", window_hashes(F.col("words")))


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejects: float

    @property
    def worth(self) -> float:
        return self.rejects / max(self.seconds, 1e-3)


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` random texts: of SAMPLE_FILES random files if ``df`` is read from more, so that measuring costs does
    not read a large table twice."""
    files, spark = df.inputFiles(), df.sparkSession
    # Names with escaped characters are no paths again.
    if len(files) > SAMPLE_FILES and all(f.endswith(".parquet") and "%" not in f for f in files):
        chosen = random.Random(SEED).sample(sorted(files), SAMPLE_FILES)
        df = spark.read.schema(df.select("text").schema).parquet(*chosen)
    n = df.count()
    return df.select("text").sample(fraction=min(1.0, rows / max(n, 1)), seed=SEED)


def measure(df: DataFrame, rule_set: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows (a sample by design). A rule's cost is the least
    time of a few runs in turn, after one that compiles it, less that of a rule that looks at no text."""
    sample = sampled(df, sample_rows).repartition(1).persist()
    try:
        n = max(sample.count(), 1)
        frames = {r.name: prepared(sample).where(r.fails) for r in rule_set}
        frames[""] = sample.where(F.rand(SEED) < 0)
        hits = {name: frame.count() for name, frame in frames.items()}
        least = dict.fromkeys(frames, float("inf"))
        for _ in range(REPEATS):
            for name, frame in frames.items():
                began = time.perf_counter()
                frame.count()
                least[name] = min(least[name], time.perf_counter() - began)
        return [Measured(r.name, max(least[r.name] - least[""], 0.0), hits[r.name] / n) for r in rule_set]
    finally:
        sample.unpersist()


def order(rule_set: list[Rule], measured: list[Measured]) -> list[Rule]:
    """By rejection per cost, best first; rules that rejected nothing keep their order by cost."""
    by = {m.name: m for m in measured}
    return sorted(rule_set, key=lambda r: (-by[r.name].worth, by[r.name].seconds))


def cascade(rule_set: list[Rule]) -> Column:
    """The name of the first rule that a row fails, null if none: later branches are not evaluated."""
    head, *rest = rule_set
    out = F.when(head.fails, F.lit(head.name))
    for rule in rest:
        out = out.when(rule.fails, F.lit(rule.name))
    return out


def failed_rule(df: DataFrame) -> DataFrame:
    """``df`` (with ``text``) and a column ``failed_rule``, by the cascade in measured order."""
    ordered = order(rules(), measure(df, rules()))
    names = df.columns
    inner = df.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"), F.col("text"))
    return prepared(inner).select("row", cascade(ordered).alias("failed_rule")).select("row.*", "failed_rule")


def statistics(df: DataFrame, *keep: str) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): its id, the statistics and the columns ``keep``."""
    text, words = F.col("text"), F.col("words")
    return prepared(df.select("doc_id", "text", *keep)).select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        word_chars(words).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(F.col("lines")).alias("n_dup_lines"),
        n_repeat_words(F.col("hashes")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        n_capitals(text).alias("n_capitals"),
        *keep,
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's verdict on each text, and beside it the statistics that are asked of every text, rejected or not."""
    judged = failed_rule(documents(spark, sf_dir).select("doc_id", "text"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return statistics(judged, "failed_rule").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that fail a rule go. An empty table stays empty."""
    return failed_rule(docs).where(F.col("failed_rule").isNull()).drop("failed_rule")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals
    FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > word_chars) AS kept
FROM b
"""
