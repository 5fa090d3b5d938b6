"""The vector engine against fixed vectors, brute force and statistics."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.functions import bits as B, hadamard as H, probability as P, vectors as V
from vecmill.operators import cross_polytope as X, estimators as E, exact, metrics, prefix_join as J, search as S
from vecmill.operators.index import IndexMismatch, LshIndex
from vecmill.operators.simhash import SimHash, SimHashBuilder
from vecmill.plans import catalog
from vecmill.sources.vectors import ANGULAR, EUCLIDEAN, Metric, VectorTable, ground_truth, queries_of


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def table_of(spark, n=200, d=16, seed=0, metric=ANGULAR):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return VectorTable.from_arrays(spark, x.tolist(), metric), x


def test_every_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    for name in catalog.SQL:
        got = catalog.QUERIES[name](spark, sf_dir).toPandas()
        want = con.execute(catalog.SQL[name]).df()[got.columns]
        keys = list(got.columns)
        pairs = zip(got.sort_values(keys).itertuples(index=False), want.sort_values(keys).itertuples(index=False), strict=True)
        assert all(a == b for a, b in pairs), name


def test_bit_packing(spark):
    flags = lambda *on: F.array(*[F.lit(i in on) for i in range(32)])
    row = one(spark, *[B.pack(flags(*on)) for on in ((0,), (1,), (1, 2), (31,))], B.pack(F.array(F.lit(True))))
    assert tuple(row) == (1 << 31, 1 << 30, (1 << 30) + (1 << 29), 1, 1 << 31)
    assert one(spark, B.bit_string(F.lit(1 << 31)))[0] == "1" + "0" * 31


def test_lcp_and_prefixes(spark):
    rng = random.Random(1)
    pairs = [(a, a ^ (rng.getrandbits(32) >> rng.randrange(33))) for a in (rng.getrandbits(32) for _ in range(200))] + [(5, 5), (0, 1 << 31)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", B.lcp(F.col("a"), F.col("b")).alias("n"), B.prefix_eq(F.col("a"), F.col("b"), 7).alias("eq")).collect():
        same = next((i for i in range(32) if (r.a ^ r.b) >> (31 - i) & 1), 32)
        assert r.n == same and r.eq == (same >= 7)


@pytest.mark.parametrize("form", ["expression", "batch", "sql"])
def test_hadamard_fixed_vector(spark, form):
    df = spark.createDataFrame([([1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0],)], "v array<double>")
    if form == "expression":
        got = df.select(H.hadamard(F.col("v"), 8)).first()[0]
    elif form == "batch":
        got = H.transform(df, "v").first()[0]
    else:
        H.register(spark)
        df.createOrReplaceTempView("t")
        got = spark.sql("SELECT fht(v) FROM t").first()[0]
        assert spark.sql("SELECT dot(v, v), lcp32(1, 1), lcp32(0, 1) FROM t").first()[:] == (4.0, 32, 31)
    assert got == [4, 2, 0, -2, 0, 2, 0, 2]


def test_hadamard_equals_the_sign_matrix_and_checks_lengths():
    for log in range(11):
        n = 1 << log
        x = np.random.default_rng(log).choice([-1.0, 1.0], n)
        h = np.array([[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)])
        assert np.abs(H.butterfly(x) - h @ x).max() <= 1e-5
    for bad in (0, 3, 12):
        with pytest.raises(ValueError):
            H.butterfly(np.zeros(bad))


@pytest.mark.parametrize("metric", [ANGULAR, EUCLIDEAN])
def test_exact_search(spark, metric):
    table, x = table_of(spark, metric=metric)
    queries = table.df.where("vec_id < 3")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = exact.knn(table, queries, 5).orderBy("qid", "rank").collect()
    for q in range(3):
        d = 1 - u @ u[q] if metric == ANGULAR else ((x - x[q]) ** 2).sum(1)
        want = sorted((round(float(v), 6) + 0.0, i) for i, v in enumerate(np.maximum(d, 0)))[:5]
        assert [(abs(r.d), r.vec_id) for r in got if r.qid == q] == [(abs(a), i) for a, i in want]
        near = {r.vec_id for r in exact.within(table, queries, 0.8).collect() if r.qid == q}
        assert near == {i for i, v in enumerate(d) if round(float(v), 6) <= 0.8}
    assert exact.knn(table, queries, 1000).count() == 600
    with pytest.raises(ValueError):
        exact.knn(table, queries, 0)


def test_blocks_of_queries_equal_a_broadcast(spark, monkeypatch):
    table, _ = table_of(spark)
    whole = sorted(exact.knn(table, table.df, 3).collect())
    monkeypatch.setattr(exact, "QUERY_BLOCK", 60)
    assert sorted(exact.knn(table, table.df, 3).collect()) == whole


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 4.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])]
    table = VectorTable.of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert (table.num_points(), table.dropped(), table.num_dimensions()) == (2, 5, 2)
    assert table.get(4).first()["v"] == [0.6, 0.8]


def test_dot_of_other_lengths_is_null(spark):
    assert one(spark, V.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))[0] is None


def test_simhash_collision_frequency(spark):
    table, x = table_of(spark, n=40)
    hasher = SimHash(16, 32, 400, 1234)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    h = hasher.hashes(u)
    bits = (h[:, :, None] >> np.arange(32)) & 1
    flat = bits.reshape(40, -1)
    for i in range(0, 40, 7):
        for j in range(40):
            p = 1 - np.arccos(np.clip(u[i] @ u[j], -1, 1)) / np.pi
            assert abs((flat[i] == flat[j]).mean() - p) <= 0.02
    stored = {(r.vec_id, r.rep): r.hash for r in SimHashBuilder(16, 32).build_vec(2).hash(table.df).collect()}
    assert all(stored[i, r] == SimHash(16, 32, 2).hashes(u)[i, r] for i in range(40) for r in range(2))
    with pytest.raises(ValueError):
        SimHash(16, 33)


def procedural(u, q, hasher, k, delta):
    """The visits one by one, with a sorted list of the best."""
    h, (bits, reps) = hasher.hashes(u), (hasher.bits, hasher.reps)
    d = np.array([round(float(v), 6) for v in 1 - u @ u[q]])
    best, seen, visits = [], set(), 0
    for prefix in range(bits, -1, -1):
        for rep in range(reps):
            for i in range(len(u)):
                x = int(h[i, rep] ^ h[q, rep])
                if bits - x.bit_length() == prefix:
                    visits += 1
                    if i not in seen:
                        seen.add(i)
                        best = sorted([*best, (d[i], i)])[:k]
            if len(best) == k:
                p = 1 - np.arccos(np.clip(1 - best[-1][0], -1, 1)) / np.pi
                fail = (1 - p**prefix) ** (rep + 1) * ((1 - p ** (prefix + 1)) ** (reps - rep - 1) if prefix < bits else 1)
                if fail < delta:
                    return [i for _, i in best], prefix, rep + 1, visits
    return [i for _, i in best], 0, reps, visits


def test_adaptive_search_equals_the_procedure(spark):
    table, x = table_of(spark, n=150)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hasher = SimHash(16, 12, 4)
    index = LshIndex.build(table, hasher)
    for k, delta in ((1, 0.1), (5, 0.3)):
        got = S.search(index, table.df.where("vec_id < 6"), k, delta).orderBy("qid", "rank").collect()
        for q in range(6):
            ids, prefix, rep, visits = procedural(u, q, hasher, k, delta)
            own = [r for r in got if r.qid == q]
            assert [r.vec_id for r in own] == ids and {(r.stop_prefix, r.stop_rep, r.collisions) for r in own} == {(prefix, rep, visits)}
    assert S.search(index, table.df.where("vec_id = 0"), 1000, 0.1).count() == 150
    with pytest.raises(ValueError):
        S.search(index, table.df, 0, 0.1)


def test_index_round_trip_and_mismatch(spark, tmp_path):
    table, _ = table_of(spark, n=50)
    other, _ = table_of(spark, n=50, seed=1)
    index = LshIndex.build(table, SimHash(16, 16, 2))
    index.save(str(tmp_path / "i"))
    assert LshIndex.load(spark, str(tmp_path / "i"), table).same(index)
    with pytest.raises(IndexMismatch):
        LshIndex.load(spark, str(tmp_path / "i"), other)
    first = LshIndex.build_cached(spark, table, SimHash(16, 16, 2), str(tmp_path / "c"))
    again = LshIndex.build_cached(spark, table, SimHash(16, 16, 2), str(tmp_path / "c"))
    assert first.same(index) and again.same(index)
    assert not index.same(LshIndex.build(other, SimHash(16, 16, 2)))
    with pytest.raises(ValueError):
        LshIndex.build(VectorTable.from_arrays(spark, [[1.0, 2.0]], EUCLIDEAN), SimHash(2))


def test_cross_polytope_index_round_trip_and_search(spark, tmp_path):
    table, x = table_of(spark, n=120, d=12)
    hasher = X.CrossPolytopeHash(12, 3, 4)
    index = LshIndex.build_cached(spark, table, hasher, str(tmp_path))
    assert index.same(LshIndex.build_cached(spark, table, hasher, str(tmp_path)))
    packed = {(r.vec_id, r.rep): r.hash for r in index.df.collect()}
    for rep in range(4):
        for r in hasher.family(rep).hash(table.df).collect():
            assert packed[r.vec_id, rep] == (r.symbols[0] << 10) + (r.symbols[1] << 5) + r.symbols[2]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k, delta in ((1, 0.1), (4, 0.3)):
        got = S.search(index, table.df.where("vec_id < 4"), k, delta).orderBy("qid", "rank").collect()
        for q in range(4):
            ids, prefix, rep, visits = by_symbols(u, q, packed, hasher, k, delta)
            own = [r for r in got if r.qid == q]
            assert [r.vec_id for r in own] == ids and {(r.stop_prefix, r.stop_rep, r.collisions) for r in own} == {(prefix, rep, visits)}
    chance = one(spark, *[hasher.collision_probability(F.lit(d)) for d in (0.0, 0.35, 2.0)])
    assert np.allclose(list(chance), hasher.probability(np.array([0.0, 0.35, 2.0])))
    with pytest.raises(ValueError):
        X.CrossPolytopeHash(64, 9)
    with pytest.raises(ValueError):
        LshIndex.build(VectorTable.from_arrays(spark, [[1.0, 2.0]], EUCLIDEAN), X.CrossPolytopeHash(2))


def by_symbols(u, q, packed, family, k, delta):
    d = np.array([round(float(v), 6) for v in 1 - u @ u[q]])
    symbols = lambda h: [h >> family.unit * (family.bits - 1 - f) & ((1 << family.unit) - 1) for f in range(family.bits)]
    shared = {(i, r): next((f for f, (a, b) in enumerate(zip(symbols(packed[i, r]), symbols(packed[q, r]), strict=True)) if a != b), family.bits) for i in range(len(u)) for r in range(family.reps)}
    seen, visits = set(), 0
    for prefix in range(family.bits, -1, -1):
        for rep in range(family.reps):
            new = [i for i in range(len(u)) if shared[i, rep] == prefix]
            visits += len(new)
            seen.update(new)
            best = sorted((d[i], i) for i in seen)[:k]
            if len(best) == k:
                p = float(family.probability(np.array([best[-1][0]]))[0])
                if (1 - p**prefix) ** (rep + 1) * ((1 - p ** (prefix + 1)) ** (family.reps - rep - 1) if prefix < family.bits else 1) < delta:
                    return [i for _, i in best], prefix, rep + 1, visits
    return [i for _, i in best], 0, family.reps, visits


def test_recall_of_the_adaptive_search(spark):
    table, q = queries_of(spark, "/root/testdata/sf0.1")
    index = LshIndex.build(table, SimHashBuilder(table.num_dimensions(), 32).build_vec(64))
    found = S.search(index, q, 10, 0.1)
    assert metrics.mean_recall(metrics.recall_by_ids(exact.knn(table, q, 10), found)).first()["recall"] >= 0.9


def test_metric_of_the_callers_own(spark):
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    manhattan = Metric("manhattan", lambda v: v, lambda a, b, aa, bb: total(a, b))
    table, x = table_of(spark, n=80, metric=manhattan)
    for r in exact.knn(table, table.df.where("vec_id < 5"), 1 + 3).where("rank > 1").collect():
        assert abs(r.d - np.sort(np.abs(x - x[r.qid]).sum(1))[r["rank"] - 1]) < 1e-6
    with pytest.raises(ValueError):
        LshIndex.build(table, SimHash(16))
    with pytest.raises(ValueError):
        table_of(spark, metric="cosine?")


def test_filters_of_two_caps(spark):
    """The distance to where two caps meet, against a search along the first cap's edge."""
    for inner, a, b in ((0.3, 1.0, 1.0), (0.8, 2.0, 0.5), (-0.4, 1.5, 1.2)):
        across = np.linspace(-20, 20, 400_001)
        meets = np.abs(a * inner + across * np.sqrt(1 - inner * inner) - b).argmin()
        got = one(spark, P.squared_reach(F.lit(inner), F.lit(a), F.lit(b)))[0]
        assert abs(got - (a * a + across[meets] ** 2)) < 1e-2


def test_throughput_and_order_by_recall(spark):
    seconds, rate = metrics.throughput(lambda: spark.range(10), 10)
    assert seconds > 0 and rate == 10 / seconds
    rows = metrics.by_recall(spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.5)], "qid long, recall double")).collect()
    assert [(r.place, r.qid) for r in sorted(rows)] == [(1, 2), (2, 1), (3, 3)]


def test_single_precision_transform_stays_single():
    x = np.random.default_rng(0).standard_normal((3, 256), dtype=np.float32)
    got = H.butterfly(x)
    assert got.dtype == np.float32 and np.allclose(got, H.butterfly(x.astype(np.float64)), atol=1e-3)
    assert H.butterfly(x[:, :1]).tolist() == x[:, :1].tolist()


def test_pairs_of_buckets(spark):
    rng = random.Random(3)
    rows = [(r, rng.getrandbits(6), i) for r in range(2) for i in range(40)]
    index = spark.createDataFrame(rows, "rep int, hash long, vec_id long")
    h = {(r, i): x for r, x, i in rows}
    lcp = lambda a, b: 6 - (a ^ b).bit_length()
    got = {tuple(r) for r in J.bucket_pairs(index, 3, 6).collect()}
    assert got == {(r, a, b) for r in range(2) for a in range(40) for b in range(a + 1, 40) if lcp(h[r, a], h[r, b]) >= 3}
    hashed = J.query_hashes(index, spark.createDataFrame([(0,)], "vec_id long"))
    near = {(r, i): lcp(h[r, 0], h[r, i]) for r in range(2) for i in range(40)}
    nested = {(r.rep, r.a, r.b) for r in J.nested_pairs(index, hashed, 1, 6).collect()}
    assert nested == {(r, a, b) for r in range(2) for a in range(40) for b in range(a + 1, 40) if min(near[r, a], near[r, b]) == 1}
    crossed = {(r.rep, r.a, r.b) for r in J.cross_pairs(index, hashed, 1, 6).collect()}
    assert crossed == {(r, a, b) for r in range(2) for a in range(40) for b in range(40) if near[r, a] > 1 and near[r, b] == 1}


def test_cross_polytope(spark, tmp_path):
    v = F.array(*[F.lit(x) for x in (1.0, -3.0, 3.0, 9.0)])
    assert one(spark, X.closest_axis(v, 3, 4))[0] == 5
    table, x = table_of(spark, n=60, d=12)
    family = X.CrossPolytope(12, 3)
    symbols = {r.vec_id: r.symbols for r in family.hash(table.df).collect()}
    assert family.power == 16 and family.bits_per_function == 5 and all(len(s) == 3 and 0 <= min(s) <= max(s) < 32 for s in symbols.values())
    probs = X.cached_probabilities(spark, str(tmp_path), 8, steps=10, samples=2000)
    again = X.cached_probabilities(spark, str(tmp_path), 8, steps=10, samples=2000)
    p = {round(r.dotp, 3): r.p for r in probs.collect()}
    assert p == {round(r.dotp, 3): r.p for r in again.collect()} and p[1.0] == 1 and p[-1.0] == 0 and abs(p[0.0] - 1 / 16) < 0.03
    mid = X.interpolated(spark.createDataFrame([(0.9,), (1.0,)], "x double"), "x", probs, 10).orderBy("x").collect()
    assert abs(mid[0].p - (p[0.8] + p[1.0]) / 2) < 1e-9 and mid[1].p == 1
    X.write_csv(probs, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["dim", "dotp", "p"]


def test_probabilities(spark):
    row = one(spark, P.simhash_collision(F.lit(-1e-7)), P.simhash_collision(F.lit(2.0)), P.normal_cdf(F.lit(0.0)), P.normal_cdf(F.lit(1.96)), P.pstable_collision(F.lit(1.0), 1.0), P.count_threshold(F.lit(0.0), 0.1, 10))
    assert row[0] == 1 and row[1] == 0 and abs(row[2] - 0.5) < 1e-6 and abs(row[3] - 0.975) < 1e-4 and abs(row[4] - 0.36853) < 1e-3 and row[5] == 1


@pytest.mark.parametrize("s", [None, 10])
def test_estimates_project_only_queries_at_large(spark, monkeypatch, s):
    table, x = table_of(spark, n=250, d=12)
    matrix, real, seen = E.projection(12, 32), E.project, []
    monkeypatch.setattr(E, "project", lambda df, m: seen.append(df.count()) or real(df, m))
    monkeypatch.setattr(E, "QUERY_BLOCK", 2, raising=False)
    monkeypatch.setattr(E, "ROW_BLOCK", 40, raising=False)
    monkeypatch.setattr(catalog, "PROJECTIONS", 32)
    monkeypatch.setattr(catalog, "queries_of", lambda *a: (table, table.df.where("vec_id % 50 = 0")))
    got = {(r.qid, r.vec_id): r.estimate for r in (catalog.ceo_multi if s else catalog.ceo_single)(spark, "").collect()}
    monkeypatch.undo()
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ matrix.T
    scale = np.sqrt(2 * np.log(32))
    for q in range(0, 250, 50):
        order = np.argsort(-y[q])
        want = y[:, order[0]] / scale if s is None else (y[:, order[:10]].sum(1) - y[:, order[-10:]].sum(1)) / (20 * scale)
        assert np.allclose([got.pop((q, i)) for i in range(250)], want, atol=1e-6)
    assert not got and seen == [5]


def test_estimates_of_repeated_and_missing_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (1, [0.0, 1.0]), (None, [0.8, 0.6])]
    table = VectorTable.of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    matrix = np.array([[1.0, 0.0], [0.0, 2.0], [-1.0, 0.0]])
    got = {r.vec_id: r.estimate for r in E.estimate(table.df, table.df.where("vec_id = 0"), matrix, 1).collect()}
    assert got == {i: round(float(t) / (2 * np.sqrt(2 * np.log(3))), 6) for i, t in ((0, 2.0), (1, 1.2), (None, 1.6))}


def test_ground_truth_in_long_form(spark):
    df = spark.createDataFrame([(0, [5, 7], [0.1, 0.2])], "qid long, neighbors array<long>, distances array<double>")
    assert [tuple(r) for r in ground_truth(df, k=1).collect()] == [(0, 1, 5, 0.1)]


def test_stream_of_queries(spark, tmp_path):
    from vecmill.streaming.search import search_stream

    table, x = table_of(spark, n=50)
    spark.createDataFrame([(100 + i, x[i].tolist()) for i in range(3)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("vec_id long, embedding array<double>").parquet(str(tmp_path / "q"))
    got = []
    search_stream(stream, table, 1, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert {(r.qid, r.vec_id) for r in got} == {(100 + i, i) for i in range(3)}


def test_range_experiment_csv(spark, tmp_path):
    from vecmill.sources.vectors import read_range_experiment

    (tmp_path / "res.csv").write_text("range,visited,threshold_probability,threshold_probability_bound\n0.5,10,0.25,0.125\n")
    assert tuple(read_range_experiment(spark, str(tmp_path / "res.csv")).first()) == (0.5, 10, 0.25, 0.125)
