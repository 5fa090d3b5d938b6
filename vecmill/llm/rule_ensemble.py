"""Operator 6: a quality classifier as a sparse rule ensemble.

Small trees are boosted on statistics of labelled texts; every path of every tree is a conjunctive rule. A
lasso-penalized logistic regression keeps the rules that help. The fitted model is compiled into one Spark
column expression, so scoring runs inside the scan, without Python and without a shuffle.

The fit uses a bounded sample: TRAIN_ROWS labelled rows, the first by the hash of their id. Rows whose
crc32(id as text) modulo 4 is 2 are held out. Inputs are statistics of the text alone.

Defined results: null and empty texts have all statistics 0 and get that score; without labels of both classes
the score is their share of 1, or 0.5 without any; repeated and conflicting labels of an id count by their mean;
rows with a null id are scored and not held out; texts that share an id are rows of their own; an empty table gives no
rows; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecmill.llm.common import documents, let, word_list
from vecmill.llm.quality_rules import n_dup_lines, worded_lines

TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 24
PENALTY = 2e-3
THRESHOLD = 0.7
SEED = 5


def share_of(text: Column, pattern: str, whole: Column) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(whole, F.lit(1))


def statistics(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) as (doc_id, s0, s1 ...): statistics of the whole text, all doubles."""
    text = F.coalesce("text", F.lit(""))

    def of_words(w: Column) -> Column:
        n, chars = F.size(w), F.length(F.array_join(w, ""))
        return F.struct(n.alias("n"), chars.alias("chars"), F.size(F.array_distinct(w)).alias("distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), n_dup_lines(x).alias("dup"))

    rows = df.select("doc_id", text.alias("text"), let(word_list(text), of_words).alias("w"), let(worded_lines(text), of_lines).alias("l"))
    chars, n, lines = F.col("w.chars"), F.greatest("w.n", F.lit(1)), F.greatest("l.n", F.lit(1))
    out = [
        F.log1p("w.n"),
        chars / n,
        F.col("w.distinct") / n,
        F.col("l.dup") / lines,
        F.col("w.n") / lines,
        share_of(F.col("text"), r"[^#*$%&|<>]+", chars),
        share_of(F.col("text"), r"[^A-Z]+", chars),
        share_of(F.col("text"), r"[^0-9]+", chars),
        share_of(F.col("text"), r"[^.,;:?]+", chars),
        share_of(F.col("text"), r"[^!]+", chars),
    ]
    return rows.select("doc_id", *[x.cast("double").alias(f"s{i}") for i, x in enumerate(out)])


N_STATISTICS = 10

Rule = tuple[tuple[int, bool, float], ...]
"""Conditions (statistic, whether above, threshold); all must hold."""


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The fitted model as a column expression over s0, s1 ..."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, at in rule:
                test = test & (F.col(f"s{k}") > at if above else F.col(f"s{k}") <= at)
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, at in rule:
        out &= x[:, k] > at if above else x[:, k] <= at
    return out


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """A regression tree on the residuals ``g``: adds its paths to ``rules`` and its leaf means to ``out``."""
    best = (1e-9, None)
    total, n = g[rows].sum(), len(rows)
    for k in range(x.shape[1]) if depth else ():
        if not len(edges[k]):
            continue
        sums = np.bincount(binned[rows, k], g[rows], len(edges[k]) + 1).cumsum()[:-1]
        count = np.bincount(binned[rows, k], minlength=len(edges[k]) + 1).cumsum()[:-1]
        ok = (count >= 10) & (n - count >= 10)
        gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], (k, at))
    if path:
        rules.append(tuple(sorted(path)))
    if best[1] is None:
        out[rows] = total / n
        return
    k, at = best[1]
    right = binned[rows, k] > at
    for above, part in ((False, rows[~right]), (True, rows[right])):
        grow(x, binned, edges, g, part, depth - 1, (*path, (k, above, float(edges[k][at]))), rules, out)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    edges = [e[e < x[:, k].max()] for k, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1)
    found: list[Rule] = []
    z = np.zeros(len(y))
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        step = np.zeros(len(y))
        rules: list[Rule] = []
        g = y - 1 / (1 + np.exp(-z))
        grow(x, binned, edges, g, rows, DEPTH, (), rules, step)
        # Rows outside the sample take the value of their leaf through the rules of full paths.
        for rule in rules:
            inside = holds(rule, x)
            if len(chosen := rows[inside[rows]]):
                step[inside] = g[chosen].mean()
        z += 0.3 * 4 * step
        found += rules
    kept = list(dict.fromkeys(found))
    if not kept:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    m = np.stack([holds(r, x) for r in kept], axis=1).astype(np.float64)
    return lasso(m, y, kept)


def lasso(m: np.ndarray, y: np.ndarray, rules: list[Rule]) -> Model:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    mean = m.mean(0)
    c = m - mean
    step = 4 / (np.linalg.norm(c, 2) ** 2 / len(y) + 1)
    w, v, b, vb, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), 0.0, 0.0, 1.0
    for _ in range(400):
        r = 1 / (1 + np.exp(-(c @ v + vb))) - y
        nw = v - step * (c.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    on = np.flatnonzero(np.abs(w) > 1e-3)
    bias = float(b - mean[on] @ w[on])
    return Model(bias, tuple((rules[i], float(w[i])) for i in on))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on ``rows`` labelled rows at most: their ids are broadcast, their statistics come to the driver."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    of = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    of = statistics(of.select(F.struct("doc_id", "quality").alias("doc_id"), "text"))
    table = of.select("doc_id.doc_id", (F.col("doc_id.quality") >= 0.5).cast("double").alias("y"), *[f"s{i}" for i in range(N_STATISTICS)])
    # Texts that share an id share its label; the bound holds for them too.
    data = table.orderBy(F.xxhash64("doc_id"), "doc_id", *[f"s{i}" for i in range(N_STATISTICS)]).limit(rows).toPandas().to_numpy(dtype=np.float64)
    return fit(data[:, 2:], data[:, 1])


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = statistics(docs).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
