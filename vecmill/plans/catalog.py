"""Registered queries over ``embeddings`` and the same rows in DuckDB's SQL.

Searches take as queries the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecmill.functions import bits as B, hadamard as H, probability as P, vectors as V
from vecmill.operators import cross_polytope as X, estimators as E, exact, metrics, prefix_join as J, search as S
from vecmill.operators.index import LshIndex
from vecmill.operators.simhash import SimHash, SimHashBuilder
from vecmill.sources.durable import shared_dir
from vecmill.sources.vectors import ANGULAR, EUCLIDEAN, Metric, VectorTable, fingerprint_frame, ground_truth, queries_of

BITS, REPS, K, DELTA = 16, 8, 10, 0.1
RANGE_BITS, RANGE_REPS, RANGE_SIM = 4, 24, 0.3
PREFIX = 6
PROJECTIONS = 1024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Raw (e), Euclidean (n) and unit vectors (u), and all (query, row) pairs with both distances.
BASE = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, list_dot_product(v, v) AS sq FROM e WHERE list_dot_product(v, v) > 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(sq)) AS v FROM n),
ap AS (SELECT q.vec_id AS qid, r.vec_id AS vec_id, round(1 - list_dot_product(q.v, r.v), 6) + 0.0 AS d FROM u q, u r WHERE q.vec_id % 100 = 0),
ep AS (SELECT q.vec_id AS qid, r.vec_id AS vec_id, round(greatest(0, q.sq + r.sq - 2 * list_dot_product(q.v, r.v)), 6) + 0.0 AS d FROM n q, n r WHERE q.vec_id % 100 = 0)"""


def gauss(tag: str, *key: str) -> str:
    digest = f"md5(concat_ws(':', '{tag}', {', '.join(key)}))"
    u = f"((('0x' || substr({digest}, 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"
    w = f"(('0x' || substr({digest}, 9, 8))::BIGINT / 4294967296::DOUBLE)"
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {w})"


def hashes_sql(bits: int, reps: int) -> str:
    """``h`` (rep, vec_id, hash)."""
    return f"""dirs AS (SELECT r AS rep, f AS func, list(g ORDER BY d) AS dir FROM (SELECT r, f, d, {gauss('simhash1234', 'r', 'f', 'd')} AS g
    FROM range({reps}) a(r), range({bits}) b(f), range((SELECT max(len(v)) FROM u)) c(d)) GROUP BY r, f),
h AS (SELECT rep::INT AS rep, vec_id, sum(CASE WHEN list_dot_product(dir, v) >= 0 THEN 1 << ({bits} - 1 - func) ELSE 0 END)::BIGINT AS hash FROM u, dirs GROUP BY rep, vec_id)"""


def lcp_sql(a: str, b: str, bits: int) -> str:
    return f"(CASE WHEN xor({a}, {b}) = 0 THEN {bits} ELSE {bits} - length(bin(xor({a}, {b}))) END)::INT"


MET = f"c AS (SELECT q.vec_id AS qid, p.vec_id, q.rep, {lcp_sql('q.hash', 'p.hash', BITS)} AS lcp FROM h q JOIN h p ON q.rep = p.rep WHERE q.vec_id % 100 = 0)"
SEARCH = f"""{BASE}, {hashes_sql(BITS, REPS)}, {MET},
s AS (SELECT *, ({BITS} - lcp) * {REPS} + rep AS step FROM c),
f AS (SELECT qid, vec_id, min(step) AS step, any_value(ap.d) AS d FROM s JOIN ap USING (qid, vec_id) GROUP BY qid, vec_id),
w AS (SELECT qid, step, list_sort(list(d) OVER (PARTITION BY qid ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS ds FROM f),
a AS (SELECT qid, step, max(ds[{K}]) AS kd FROM w WHERE len(ds) >= {K} GROUP BY qid, step),
st AS (SELECT qid, t AS step FROM (SELECT DISTINCT qid FROM f), range({(BITS + 1) * REPS}) x(t)),
k AS (SELECT st.qid, st.step, last_value(a.kd IGNORE NULLS) OVER (PARTITION BY st.qid ORDER BY st.step) AS kd FROM st LEFT JOIN a ON st.qid = a.qid AND st.step = a.step),
p AS (SELECT qid, step, {BITS} - step // {REPS} AS pre, step % {REPS} + 1 AS j, 1 - acos(greatest(-1::DOUBLE, least(1::DOUBLE, 1 - kd))) / pi() AS p FROM k WHERE kd IS NOT NULL),
fp AS (SELECT qid, step, power(1 - power(p, pre), j) * CASE WHEN pre < {BITS} THEN power(1 - power(p, pre + 1), {REPS} - j) ELSE 1 END AS fp FROM p),
stop AS (SELECT qid, min(step) AS stop FROM fp WHERE fp < {DELTA} GROUP BY qid),
visits AS (SELECT s.qid, count(*) AS collisions FROM s JOIN stop ON s.qid = stop.qid AND s.step <= stop.stop GROUP BY s.qid),
ans AS (SELECT f.qid, f.vec_id, f.d, stop, row_number() OVER (PARTITION BY f.qid ORDER BY f.d, f.vec_id)::INT AS rank
    FROM f JOIN stop ON f.qid = stop.qid AND f.step <= stop.stop QUALIFY rank <= {K}),
truth AS (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM ap QUALIFY rank <= {K})"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def unit(spark: SparkSession, sf_dir: str) -> VectorTable:
    return VectorTable.read(spark, f"{sf_dir}/embeddings.parquet", ANGULAR)


def raw(spark: SparkSession, sf_dir: str) -> VectorTable:
    return VectorTable.read(spark, f"{sf_dir}/embeddings.parquet", EUCLIDEAN)


def long_form(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*(keys or ("vec_id",)), F.posexplode(column).alias("pos", "x")).withColumn("x", V.rounded(F.col("x")))


def long_sql(source: str, value: str = "v") -> str:
    return f"SELECT vec_id, i::INT AS pos, round({value}[i + 1], 6) + 0.0 AS x FROM (SELECT *, unnest(range(len({value}))) AS i FROM {source})"


# Sources, projections and scalar functions


@query("scan_vectors", f"WITH {BASE} SELECT vec_id, len(v)::INT AS dims, round(list_sum(v), 6) + 0.0 AS total FROM e")
def scan_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), V.rounded(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("normalize", f"WITH {BASE} {long_sql('u')}")
def normalize(spark, sf_dir):
    return long_form(unit(spark, sf_dir).df, "v")


@query("norms", f"WITH {BASE} SELECT vec_id, round(sq, 6) AS squared_norm, round(sqrt(sq), 6) AS norm FROM n")
def norms(spark, sf_dir):
    return raw(spark, sf_dir).df.select("vec_id", F.round("sqnorm", 6).alias("squared_norm"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query("dot_pairs", f"WITH {BASE} SELECT q.vec_id AS qid, r.vec_id AS vec_id, round(list_dot_product(q.v, r.v), 6) + 0.0 AS product FROM n q, n r WHERE q.vec_id % 100 = 0")
def dot_pairs(spark, sf_dir):
    table, q = queries_of(spark, sf_dir, EUCLIDEAN)
    q = q.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    return exact.crossed(table.df, q).select("qid", "vec_id", V.rounded(V.dot(F.col("v"), F.col("qv"))).alias("product"))


@query("angular_distance", f"WITH {BASE} SELECT * FROM ap")
def angular_distance(spark, sf_dir):
    return exact.pairs(*queries_of(spark, sf_dir, ANGULAR))


@query("euclidean_distance", f"WITH {BASE} SELECT * FROM ep")
def euclidean_distance(spark, sf_dir):
    return exact.pairs(*queries_of(spark, sf_dir, EUCLIDEAN))


@query("padded_vectors", f"WITH {BASE} SELECT vec_id, ((len(v) + 7) // 8 * 8)::INT AS stride, round(list_sum(v), 6) + 0.0 AS total FROM n")
def padded_vectors(spark, sf_dir):
    rows = raw(spark, sf_dir).df.select("vec_id", V.padded(F.col("v")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("stride"), V.rounded(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("dataset_shape", f"WITH {BASE} SELECT count(*) AS num_points, max(len(v))::INT AS num_dimensions FROM n")
def dataset_shape(spark, sf_dir):
    return raw(spark, sf_dir).df.agg(F.count("*").alias("num_points"), F.max(F.size("v")).alias("num_dimensions"))


@query(
    "dataset_fingerprint",
    f"""WITH {BASE}, r AS (SELECT sha256(vec_id || ':' || array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',')) AS h FROM u),
b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM r GROUP BY 1)
SELECT sha256('angular:' || string_agg(h, ',' ORDER BY b)) AS fingerprint FROM b""",
)
def dataset_fingerprint(spark, sf_dir):
    return fingerprint_frame(unit(spark, sf_dir).df, ANGULAR)


HADAMARD = """list_transform(range(len({v})), lambda i: list_sum(list_transform(range(len({v})), lambda j: CASE WHEN bit_count(i & j) % 2 = 0 THEN {v}[j + 1] ELSE -{v}[j + 1] END)))"""


@query("hadamard", f"WITH {BASE}, t AS (SELECT vec_id, {HADAMARD.format(v='v')} AS v FROM n) {long_sql('t')}")
def hadamard(spark, sf_dir):
    return long_form(H.transform(raw(spark, sf_dir).df.select("vec_id", "v"), "v"), "v")


# Exact search


def ranked_sql(pairs: str, k: int) -> str:
    return f"WITH {BASE} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id)::INT AS rank, vec_id, d FROM {pairs} QUALIFY rank <= {k}"


@query("knn_angular", ranked_sql("ap", 10))
def knn_angular(spark, sf_dir):
    return exact.knn(*queries_of(spark, sf_dir, ANGULAR), 10)


@query("knn_euclidean", ranked_sql("ep", 100))
def knn_euclidean(spark, sf_dir):
    return exact.knn(*queries_of(spark, sf_dir, EUCLIDEAN), 100)


@query("range_angular", f"WITH {BASE} SELECT * FROM ap WHERE d <= 0.7")
def range_angular(spark, sf_dir):
    return exact.within(*queries_of(spark, sf_dir, ANGULAR), 0.7)


@query("range_euclidean", f"WITH {BASE} SELECT * FROM ep WHERE d <= 1.4")
def range_euclidean(spark, sf_dir):
    return exact.within(*queries_of(spark, sf_dir, EUCLIDEAN), 1.4)


@query(
    "mips_top1",
    f"""WITH {BASE}, x AS (SELECT q.vec_id AS qid, r.vec_id AS vec_id, round(list_dot_product(q.v, r.v), 6) AS product FROM n q, n r WHERE q.vec_id % 100 = 0)
SELECT qid, vec_id, product FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY product DESC, vec_id) = 1""",
)
def mips_top1(spark, sf_dir):
    table, q = queries_of(spark, sf_dir, EUCLIDEAN)
    return exact.largest_product(table.df, q)


@query("ground_truth_long", ranked_sql("ap", 10).replace("vec_id, d FROM ap", "vec_id, d AS dist FROM ap"))
def ground_truth_long(spark, sf_dir):
    rows = exact.knn(*queries_of(spark, sf_dir, ANGULAR), 20)
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "d"))).alias("x"))
    arrays = lists.select("qid", F.col("x.vec_id").alias("neighbors"), F.col("x.d").alias("distances"))
    return ground_truth(arrays, k=10)


# Sign hashes


def family(table: VectorTable, bits: int = BITS, reps: int = REPS) -> SimHash:
    return SimHashBuilder(table.num_dimensions(), bits).build_vec(reps)


def index_of(spark: SparkSession, sf_dir: str, bits: int = BITS, reps: int = REPS) -> tuple[LshIndex, DataFrame]:
    table, q = queries_of(spark, sf_dir, ANGULAR)
    return LshIndex.build(table, family(table, bits, reps)), q


@query("index_build", f"WITH {BASE}, {hashes_sql(BITS, REPS)} SELECT rep, hash, vec_id FROM h")
def index_build(spark, sf_dir):
    return index_of(spark, sf_dir)[0].df


@query("simhash_bits", f"WITH {BASE}, {hashes_sql(32, 1)} SELECT vec_id, hash, lpad(bin(hash), 32, '0') AS bits FROM h")
def simhash_bits(spark, sf_dir):
    return index_of(spark, sf_dir, 32, 1)[0].df.select("vec_id", "hash", B.bit_string(F.col("hash")).alias("bits"))


@query("hash_buckets", f"WITH {BASE}, {hashes_sql(BITS, REPS)} SELECT rep, hash, count(*) AS n, min(vec_id) AS first_id FROM h GROUP BY rep, hash")
def hash_buckets(spark, sf_dir):
    return index_of(spark, sf_dir)[0].df.groupBy("rep", "hash").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("lcp", f"WITH {BASE}, {hashes_sql(BITS, REPS)}, {MET} SELECT qid, vec_id, rep, lcp FROM c")
def lcp(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return J.collisions(index.df, J.query_hashes(index.df, q), 0, BITS)


@query("prefix_collisions", f"WITH {BASE}, {hashes_sql(BITS, REPS)}, {MET} SELECT qid, vec_id, rep, lcp FROM c WHERE lcp >= {PREFIX}")
def prefix_collisions(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return J.collisions(index.df, J.query_hashes(index.df, q), PREFIX, BITS)


@query("new_collisions", f"WITH {BASE}, {hashes_sql(BITS, REPS)}, {MET} SELECT qid, vec_id, rep, lcp FROM c WHERE lcp = {PREFIX}")
def new_collisions(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return J.collisions(index.df, J.query_hashes(index.df, q), PREFIX, BITS, PREFIX + 1)


@query("simhash_collision_prob", f"WITH {BASE} SELECT qid, vec_id, round(1 - acos(greatest(-1, least(1, 1 - d))) / pi(), 6) AS p FROM ap")
def simhash_collision_prob(spark, sf_dir):
    return exact.pairs(*queries_of(spark, sf_dir, ANGULAR)).select("qid", "vec_id", F.round(P.simhash_collision(F.col("d")), 6).alias("p"))


@query(
    "empirical_collision",
    f"""WITH {BASE}, {hashes_sql(BITS, REPS)} SELECT q.vec_id AS qid, p.vec_id, round(sum({BITS} - bit_count(xor(q.hash, p.hash))) / ({BITS} * {REPS})::DOUBLE, 6) AS rate
FROM h q JOIN h p ON q.rep = p.rep WHERE q.vec_id % 100 = 0 GROUP BY ALL""",
)
def empirical_collision(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    met = J.collisions(index.df, J.query_hashes(index.df, q), 0, BITS, hashes=True)
    agree = F.lit(BITS) - F.bit_count(F.col("hash").bitwiseXOR(F.col("qhash")))
    return met.groupBy("qid", "vec_id").agg(F.round(F.sum(agree) / (BITS * REPS), 6).alias("rate"))


@query(
    "failure_probability",
    f"""SELECT d, pre::INT AS prefix, j::INT AS rep, round(power(1 - power(p, pre), j) * CASE WHEN pre < {BITS} THEN power(1 - power(p, pre + 1), {REPS} - j) ELSE 1 END, 6) AS fp
FROM (SELECT i / 10::DOUBLE AS d, pre, j, 1 - acos(greatest(-1, least(1, 1 - i / 10::DOUBLE))) / pi() AS p FROM range(21) a(i), range(1, {BITS + 1}) b(pre), range(1, {REPS + 1}) c(j))""",
)
def failure_probability(spark, sf_dir):
    grid = spark.range(21).select((F.col("id") / 10.0).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(BITS))).alias("prefix"))
    grid = grid.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(REPS))))
    fp = P.search_failure(P.simhash_collision(F.col("d")), F.col("prefix"), F.col("rep"), BITS, REPS)
    return grid.select("d", "prefix", "rep", F.round(fp, 6).alias("fp"))


# Adaptive search


@query("adaptive_search", f"WITH {SEARCH} SELECT qid, rank, vec_id, d FROM ans")
def adaptive_search(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return S.search(index, q, K, DELTA).select("qid", "rank", "vec_id", "d")


@query("adaptive_search_stats", f"WITH {SEARCH} SELECT qid, collisions, ({BITS} - stop // {REPS})::INT AS stop_prefix, (stop % {REPS} + 1)::INT AS stop_rep FROM stop JOIN visits USING (qid)")
def adaptive_search_stats(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return S.search(index, q, K, DELTA).select("qid", "collisions", "stop_prefix", "stop_rep").distinct()


def answered(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return exact.knn(index.data, q, K), S.search(index, q, K, DELTA)


IDS = "SELECT t.qid, round(avg(CASE WHEN a.qid IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM truth t LEFT JOIN ans a ON t.qid = a.qid AND t.vec_id = a.vec_id GROUP BY t.qid"


@query("recall_set", f"WITH {SEARCH} {IDS}")
def recall_set(spark, sf_dir):
    return metrics.recall_by_ids(*answered(spark, sf_dir))


@query("recall_distance", f"WITH {SEARCH}, kth AS (SELECT qid, max(d) AS kth FROM truth GROUP BY qid) SELECT qid, round(sum(CASE WHEN d <= kth + 1e-6 THEN 1 ELSE 0 END) / {K}::DOUBLE, 6) AS recall FROM kth JOIN ans USING (qid) GROUP BY qid")
def recall_distance(spark, sf_dir):
    return metrics.recall_by_distance(*answered(spark, sf_dir), K)


@query("recall_mean", f"WITH {SEARCH} SELECT round(avg(recall), 6) AS recall, count(*) AS n_queries FROM ({IDS})")
def recall_mean(spark, sf_dir):
    return metrics.mean_recall(metrics.recall_by_ids(*answered(spark, sf_dir)))


# Collision counting

COUNTS = f"{BASE}, {hashes_sql(RANGE_BITS, RANGE_REPS)}, counts AS (SELECT q.vec_id AS qid, p.vec_id, count(*) AS n FROM h q JOIN h p ON q.rep = p.rep AND q.hash = p.hash WHERE q.vec_id % 100 = 0 GROUP BY ALL)"
BOUND = f"(power(1 - acos({RANGE_SIM}) / pi(), {RANGE_BITS}) - sqrt(ln(2 / {DELTA}) / (2 * {RANGE_REPS})))"
FOUND = f"found AS (SELECT qid, counts.vec_id, n, round(list_dot_product(q.v, r.v), 6) + 0.0 AS similarity FROM counts JOIN u q ON q.vec_id = qid JOIN u r ON r.vec_id = counts.vec_id WHERE n >= greatest(1, ceil({BOUND} * {RANGE_REPS})))"


@query("collision_counts", f"WITH {COUNTS} SELECT qid, vec_id, n AS count FROM counts")
def collision_counts(spark, sf_dir):
    return S.collision_counts(*index_of(spark, sf_dir, RANGE_BITS, RANGE_REPS))


@query("collision_range", f"WITH {COUNTS}, {FOUND} SELECT qid, vec_id, n AS count, similarity FROM found WHERE similarity >= {RANGE_SIM}")
def collision_range(spark, sf_dir):
    index, q = index_of(spark, sf_dir, RANGE_BITS, RANGE_REPS)
    return S.collision_range(index, q, RANGE_SIM, DELTA).where("hit").drop("hit")


@query(
    "collision_range_stats",
    f"""WITH {COUNTS}, {FOUND}, g AS (SELECT qid, count(*) AS visited, count_if(similarity >= {RANGE_SIM}) AS tp, count_if(similarity < {RANGE_SIM}) AS fp FROM found GROUP BY qid)
SELECT c.qid, (SELECT count(*) FROM u) AS total, coalesce(visited, 0) AS visited, coalesce(tp, 0)::BIGINT AS true_positives, coalesce(fp, 0)::BIGINT AS false_positives, c.n AS at_least_one_collision,
    round(power(1 - acos({RANGE_SIM}) / pi(), {RANGE_BITS}), 6) AS threshold_probability, round({BOUND}, 6) AS threshold_probability_bound
FROM (SELECT qid, count(*) AS n FROM counts GROUP BY qid) c LEFT JOIN g USING (qid)""",
)
def collision_range_stats(spark, sf_dir):
    index, q = index_of(spark, sf_dir, RANGE_BITS, RANGE_REPS)
    found = S.collision_range(index, q, RANGE_SIM, DELTA)
    return metrics.range_statistics(found, S.collision_counts(index, q), index.data.num_points(), *S.collision_threshold(index, RANGE_SIM, DELTA))


@query(
    "hoeffding_threshold",
    f"""SELECT i / 20::DOUBLE AS similarity, round(p, 6) AS p, round(greatest(0, p - sqrt(ln(20) / 128)), 6) AS bound, greatest(1, ceil((p - sqrt(ln(20) / 128)) * 64))::BIGINT AS threshold
FROM (SELECT i, power(1 - acos(i / 20::DOUBLE) / pi(), 4) AS p FROM range(21) t(i))""",
)
def hoeffding_threshold(spark, sf_dir):
    p = F.pow(P.simhash_collision(1 - F.col("similarity")), F.lit(4))
    grid = spark.range(21).select((F.col("id") / 20.0).alias("similarity"))
    return grid.select("similarity", F.round(p, 6).alias("p"), F.round(F.greatest(F.lit(0.0), P.hoeffding_bound(p, 0.1, 64)), 6).alias("bound"), P.count_threshold(p, 0.1, 64).alias("threshold"))


# Pairs


@query("bucket_pairs", f"WITH {BASE}, {hashes_sql(BITS, REPS)} SELECT a.rep, a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.rep = b.rep AND a.hash >> {BITS - 10} = b.hash >> {BITS - 10} AND a.vec_id < b.vec_id")
def bucket_pairs(spark, sf_dir):
    return J.bucket_pairs(index_of(spark, sf_dir)[0].df, 10, BITS)


@query("nested_pairs", f"WITH {BASE}, {hashes_sql(BITS, REPS)}, {MET} SELECT x.qid, x.rep, x.vec_id AS a, y.vec_id AS b FROM c x JOIN c y ON x.qid = y.qid AND x.rep = y.rep AND x.vec_id < y.vec_id WHERE least(x.lcp, y.lcp) = {PREFIX}")
def nested_pairs(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return J.nested_pairs(index.df, J.query_hashes(index.df, q), PREFIX, BITS)


@query("cross_range_pairs", f"WITH {BASE}, {hashes_sql(BITS, REPS)}, {MET} SELECT x.qid, x.rep, x.vec_id AS a, y.vec_id AS b FROM c x JOIN c y ON x.qid = y.qid AND x.rep = y.rep WHERE x.lcp > {PREFIX} AND y.lcp = {PREFIX}")
def cross_range_pairs(spark, sf_dir):
    index, q = index_of(spark, sf_dir)
    return J.cross_pairs(index.df, J.query_hashes(index.df, q), PREFIX, BITS)


# Cross-polytope hashes

SIGNS = "sg AS (SELECT r, list(s ORDER BY d) AS s FROM (SELECT r, d, CASE WHEN ('0x' || substr(md5(concat_ws(':', 'cross1234', 0, r, d)), 1, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM range(3) a(r), range(64) b(d)) GROUP BY r)"


def turned_sql(source: str, name: str, r: int) -> str:
    return f"{name}0 AS (SELECT vec_id, list_transform(list_zip(v, s), lambda z: z[1] * z[2]) AS v FROM {source}, sg WHERE r = {r}), {name} AS (SELECT vec_id, {HADAMARD.format(v='v')} AS v FROM {name}0)"


AXIS = "SELECT vec_id, (list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) - 1)::INT AS spot, v FROM {source}"


@query("diagonal_multiply", f"WITH {BASE}, {SIGNS}, t AS (SELECT vec_id, list_transform(list_zip(v, s), lambda z: z[1] * z[2]) AS v FROM n, sg WHERE r = 0) {long_sql('t')}")
def diagonal_multiply(spark, sf_dir):
    table = raw(spark, sf_dir)
    diagonal = X.CrossPolytope(table.num_dimensions()).diagonals[0][0]
    turned = X.diagonal_multiply(F.col("v"), F.array(*[F.lit(float(s)) for s in diagonal]))
    return long_form(table.df.select("vec_id", turned.alias("v")), "v")


@query("closest_axis", f"WITH {BASE}, x AS ({AXIS.format(source='n')}) SELECT vec_id, (spot + CASE WHEN v[spot + 1] < 0 THEN 64 ELSE 0 END)::INT AS axis FROM x")
def closest_axis(spark, sf_dir):
    table = raw(spark, sf_dir)
    family = X.CrossPolytope(table.num_dimensions())
    return table.df.select("vec_id", X.closest_axis(F.col("v"), family.dims, family.power).alias("axis"))


@query(
    "cross_polytope_hash",
    f"WITH {BASE}, {SIGNS}, {turned_sql('u', 't1', 0)}, {turned_sql('t1', 't2', 1)}, {turned_sql('t2', 't3', 2)}, x AS ({AXIS.format(source='t3')}) SELECT vec_id, (spot + CASE WHEN v[spot + 1] < 0 THEN 64 ELSE 0 END)::INT AS symbol FROM x",
)
def cross_polytope_hash(spark, sf_dir):
    table = unit(spark, sf_dir)
    return X.CrossPolytope(table.num_dimensions()).hash(table.df).select("vec_id", F.get("symbols", 0).alias("symbol"))


PAIRS = f"""g AS (SELECT k, list(a ORDER BY d) AS p, list(b ORDER BY d) AS o FROM (SELECT k, d, {gauss('pair1234', '0', 'k', 'd')} AS a, {gauss('pair1234', '1', 'k', 'd')} AS b
    FROM range(10000) x(k), range(16) y(d)) GROUP BY k),
t AS (SELECT i, p AS v0, list_transform(range(16), lambda j: round(i / 20::DOUBLE - 1, 9) * p[j + 1] + sqrt(greatest(0, 1 - round(i / 20::DOUBLE - 1, 9) * round(i / 20::DOUBLE - 1, 9))) * o[j + 1]) AS v1 FROM g, range(41) z(i)),
m AS (SELECT i, v0, v1, list_position(list_transform(v0, lambda x: abs(x)), list_max(list_transform(v0, lambda x: abs(x)))) AS a0,
    list_position(list_transform(v1, lambda x: abs(x)), list_max(list_transform(v1, lambda x: abs(x)))) AS a1 FROM t)"""


@query("cross_polytope_prob", f"WITH {PAIRS} SELECT 16::INT AS dim, round(i / 20::DOUBLE - 1, 9) AS dotp, count_if(a0 = a1 AND (v0[a0] < 0) = (v1[a1] < 0)) / 10000::DOUBLE AS p FROM m GROUP BY i")
def cross_polytope_prob(spark, sf_dir):
    return X.probabilities(spark, 16)


def packed_sql(functions: int, rep: int) -> str:
    """``hash`` of one repetition: the symbols of so many functions of 64 parts, 7 bits each."""
    seed, parts = 1234 + rep, []
    for f in range(functions):
        parts.append(f"g{f} AS (SELECT r, list(s ORDER BY d) AS s FROM (SELECT r, d, CASE WHEN ('0x' || substr(md5(concat_ws(':', 'cross{seed}', {f}, r, d)), 1, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM range(3) a(r), range(64) b(d)) GROUP BY r)")
        source = "u"
        for r in range(3):
            parts.append(turned_sql(source, f"f{f}_{r}_", r).replace(", sg WHERE", f", g{f} WHERE"))
            source = f"f{f}_{r}_"
        parts.append(f"x{f} AS ({AXIS.format(source=source)}), y{f} AS (SELECT vec_id, spot + CASE WHEN v[spot + 1] < 0 THEN 64 ELSE 0 END AS symbol FROM x{f})")
    packed = " + ".join(f"(y{f}.symbol::BIGINT << {7 * (functions - 1 - f)})" for f in range(functions))
    joins = "".join(f" JOIN y{f} USING (vec_id)" for f in range(1, functions))
    return f"WITH {BASE}, {', '.join(parts)} SELECT {rep}::INT AS rep, ({packed})::BIGINT AS hash, y0.vec_id FROM y0{joins}"


@query("cross_polytope_index", f"({packed_sql(2, 0)}) UNION ALL ({packed_sql(2, 1)})")
def cross_polytope_index(spark, sf_dir):
    table = unit(spark, sf_dir)
    return LshIndex.build(table, X.CrossPolytopeHash(table.num_dimensions(), 2, 2)).df


@query("index_saved", f"WITH {BASE}, {hashes_sql(BITS, REPS)} SELECT rep, hash, vec_id FROM h")
def index_saved(spark, sf_dir):
    """Built and saved, found again by data and hashers, and loaded."""
    table = unit(spark, sf_dir)
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    hasher = family(table)
    LshIndex.build_cached(spark, table, hasher, folder)
    return LshIndex.build_cached(spark, table, hasher, folder).df


@query("adaptive_search_cross_polytope")
def adaptive_search_cross_polytope(spark, sf_dir):
    """The adaptive search over cross-polytope hashes."""
    table, q = queries_of(spark, sf_dir, ANGULAR)
    index = LshIndex.build(table, X.CrossPolytopeHash(table.num_dimensions(), 2, REPS))
    return S.search(index, q, K, DELTA).select("qid", "rank", "vec_id", "d")


@query("custom_metric", f"WITH {BASE}, m AS (SELECT q.vec_id AS qid, r.vec_id AS vec_id, round(list_sum(list_transform(list_zip(q.v, r.v), lambda z: abs(z[1] - z[2]))), 6) + 0.0 AS d FROM n q, n r WHERE q.vec_id % 100 = 0) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id)::INT AS rank, vec_id, d FROM m QUALIFY rank <= 10")
def custom_metric(spark, sf_dir):
    """Exact search under a metric of the caller's own: the sum of absolute differences."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    manhattan = Metric("manhattan", lambda v: v, lambda a, b, aa, bb: total(a, b))
    return exact.knn(*queries_of(spark, sf_dir, manhattan), 10)


@query("fht_sql", f"WITH {BASE}, t AS (SELECT vec_id, {HADAMARD.format(v='v')} AS v FROM n) {long_sql('t')}")
def fht_sql(spark, sf_dir):
    """The transform called from SQL."""
    H.register(spark)
    return long_form(raw(spark, sf_dir).df.select("vec_id", F.expr("fht(v)").alias("v")), "v")


@query("queries_by_recall", f"WITH {SEARCH}, r AS ({IDS}) SELECT row_number() OVER (ORDER BY recall, qid)::INT AS place, qid, recall FROM r")
def queries_by_recall(spark, sf_dir):
    return metrics.by_recall(metrics.recall_by_ids(*answered(spark, sf_dir)))


# Probabilities and estimators


def cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    poly = "0::DOUBLE"
    for c in reversed(P.ERF):
        poly = f"(({poly} + {c!r}::DOUBLE) * {t})"
    erf = f"(1 - {poly} * exp(-{z} * {z}))"
    return f"(CASE WHEN {x} < 0 THEN (1 - {erf}) / 2 ELSE (1 + {erf}) / 2 END)"


@query("pstable_prob", f"SELECT z, w::INT AS w, round(1 - 2 * {cdf_sql('(-c)')} - 2 / (sqrt(2 * pi()) * c) * (1 - exp(-c * c / 2)), 6) AS p FROM (SELECT i / 2::DOUBLE AS z, w, w / (i / 2::DOUBLE) AS c FROM range(1, 61) a(i), (VALUES (1), (2), (4)) b(w))")
def pstable_prob(spark, sf_dir):
    grid = spark.range(1, 61).select((F.col("id") / 2.0).alias("z"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("w"))
    return grid.select("z", "w", F.round(P.pstable_collision(F.col("z"), F.col("w")), 6).alias("p"))


@query("simhash_prob_znorm", "SELECT i / 2::DOUBLE AS z, round(1 - acos((2000 - i * i / 4::DOUBLE) / 2000) / pi(), 6) AS p FROM range(61) t(i)")
def simhash_prob_znorm(spark, sf_dir):
    return spark.range(61).select((F.col("id") / 2.0).alias("z")).select("z", F.round(P.simhash_collision_znorm(F.col("z"), 1000), 6).alias("p"))


@query("rank_swap_prob", "SELECT d::INT AS dims, s::INT AS s, round(power(d, -s * (0.9::DOUBLE - 0.1::DOUBLE) / power(sqrt(1 - 0.81::DOUBLE) + sqrt(1 - 0.01::DOUBLE), 2)), 6) AS p FROM (SELECT unnest([2, 16, 128, 1024]) AS d), range(1, 21) t(s)")
def rank_swap_prob(spark, sf_dir):
    grid = spark.range(1, 21).select(F.col("id").cast("int").alias("s"), F.explode(F.array(*[F.lit(d) for d in (2, 16, 128, 1024)])).alias("dims"))
    return grid.select("dims", "s", F.round(P.rank_swap(F.col("dims"), F.col("s"), F.lit(0.9), F.lit(0.1)), 6).alias("p"))


@query(
    "filter_probs",
    """SELECT a AS alpha, i / 10::DOUBLE AS t, round(exp(-(1 + power(1 - a, 2) / (1 - a * a)) * i * i / 200::DOUBLE) / (2 * pi() * power(1 + i / 10::DOUBLE / a, 2)), 6) AS p1,
round(exp(-(1 + power(1 - 0.1::DOUBLE, 2) / (1 - 0.01::DOUBLE)) * i * i / 200::DOUBLE), 6) AS p2 FROM (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.999::DOUBLE]) AS a), range(10) x(i)""",
)
def filter_probs(spark, sf_dir):
    grid = spark.range(10).select((F.col("id") / 10.0).alias("t"), F.explode(F.array(F.lit(0.5), F.lit(0.9), F.lit(0.999))).alias("alpha"))
    a, t, lam = F.col("alpha"), F.col("t"), F.lit(0.0)
    return grid.select("alpha", "t", F.round(P.filter_near(a, lam, t), 6).alias("p1"), F.round(P.filter_far(a, F.lit(0.1), lam, t), 6).alias("p2"))


PROJECTED = f"pr AS (SELECT j, list(g ORDER BY d) AS dir FROM (SELECT j, d, {gauss('projection7', 'j', 'd')} AS g FROM range({PROJECTIONS}) a(j), range((SELECT max(len(v)) FROM u)) b(d)) GROUP BY j), x AS (SELECT vec_id, j, list_dot_product(dir, v) AS x FROM u, pr)"
ENDS = "o AS (SELECT vec_id AS qid, j, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 6) DESC, j) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 6), j) AS b FROM x WHERE vec_id % 100 = 0)"


def projection_of(table):
    return E.projection(table.num_dimensions(), PROJECTIONS)


def estimated(spark, sf_dir, s=None):
    table, q = queries_of(spark, sf_dir, ANGULAR)
    return E.estimate(table.df, q, projection_of(table), s)


@query("projection_profile", f"WITH {BASE}, {PROJECTED} SELECT j::INT AS j, round(max(x), 6) AS top FROM x GROUP BY j")
def projection_profile(spark, sf_dir):
    table = unit(spark, sf_dir)
    return E.profile(E.project(table.df, projection_of(table)))


@query("ceo_single", f"WITH {BASE}, {PROJECTED}, {ENDS} SELECT qid, vec_id, round(x / sqrt(2 * ln({PROJECTIONS})), 6) + 0.0 AS estimate FROM x JOIN (SELECT * FROM o WHERE a = 1) USING (j)")
def ceo_single(spark, sf_dir):
    return estimated(spark, sf_dir)


@query(
    "ceo_multi",
    f"""WITH {BASE}, {PROJECTED}, {ENDS}, t AS (SELECT qid, j, 1 AS s FROM o WHERE a <= 10 UNION ALL SELECT qid, j, -1 FROM o WHERE b <= 10)
SELECT qid, vec_id, round(sum(s * x) / (sqrt(2 * ln({PROJECTIONS})) * 20), 6) + 0.0 AS estimate FROM x JOIN t USING (j) GROUP BY qid, vec_id""",
)
def ceo_multi(spark, sf_dir):
    return estimated(spark, sf_dir, 10)


@query("ceo_summary", f"WITH {BASE}, {PROJECTED}, {ENDS}, y AS (SELECT qid, round(x / sqrt(2 * ln({PROJECTIONS})), 6) AS e FROM x JOIN (SELECT * FROM o WHERE a = 1) USING (j)) SELECT qid, max(e) AS top, round(avg(e), 5) + 0.0 AS mean, min(e) AS low FROM y GROUP BY qid")
def ceo_summary(spark, sf_dir):
    return ceo_single(spark, sf_dir).groupBy("qid").agg(F.max("estimate").alias("top"), (F.round(F.avg("estimate"), 5) + F.lit(0.0)).alias("mean"), F.min("estimate").alias("low"))


@query("concomitant_moments", f"WITH {BASE} SELECT qid, vec_id, round((1 - d) * sqrt(2 * ln(1024)), 5) + 0.0 AS expectation, round((1 - (1 - d) * (1 - d)) / (2 * ln(1024)), 5) + 0.0 AS variance FROM ap")
def concomitant_moments(spark, sf_dir):
    pairs = exact.pairs(*queries_of(spark, sf_dir, ANGULAR))
    mean, variance = E.expected_concomitant(1 - F.col("d"), F.lit(1.0), 1024)
    return pairs.select("qid", "vec_id", V.rounded(mean, 5).alias("expectation"), V.rounded(variance, 5).alias("variance"))
