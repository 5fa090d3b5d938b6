"""Operators 4 and 9 and the pipeline, against brute force and the public tokenizer library."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecmill.llm import ann, mixing, ngram_join, pieces, pii, quality_rules

MODEL = pieces.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the public tokenizer files are not here")
TEXTS = [None, "", " ", "  two  blanks ", "Hello world.", "a\nb\n\n c\t d", "é😀 ß 東京 \x00", "▁ <s> <0x0A>", "x" * 300, "the of and " * 50, "w" * 59 + " " + "ab" * 30, " " * 70 + "end", " nbsp line"]


# Operator 4


def brute(rows, queries, k):
    x = {i: np.array(v, dtype=np.float64) for i, v in rows}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    out = {}
    for q in queries:
        s = m @ x[q]
        order = sorted(((-a, i) for a, i in zip(s, ids, strict=True) if i != q))[:k]
        out[q] = [(int(i), -a) for a, i in order]
    return out


def test_ann_recall_and_scores(spark):
    big = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{big}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ann.op4_ann(spark, big).orderBy("query_id", "rank").collect()
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert {r.query_id for r in got} == set(want)
    hits = 0
    for q, true in want.items():
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in true})
    assert hits >= 0.9 * 20 * len(want)


def test_ann_of_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 50)
    monkeypatch.setattr(ann, "SHARD_ROWS", 80)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(200)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200, 300)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [float("nan"), 1.0, 1.0]), (303, [1.0, None, 2.0]), (304, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    want = brute(dict(rows[:300]).items(), range(0, 300, 20), 5)
    found = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in v}) for q, v in want.items() if q < 200)
    assert {r.query_id for r in got} == set(want) and found == 5 * 10
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).count() == 2


# Operator 9


@needs_model
def test_encoding_equals_the_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    texts = TEXTS + docs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = pieces.load()
    coded = {r.doc_id: r.ids for r in pieces.encode(df, vocabulary).collect()}
    for i, t in enumerate(texts):
        assert coded[i] == library.encode(t or ""), t
    digests = {r.doc_id: r for r in pieces.digest(df, vocabulary).collect()}
    assert all(digests[i].n_tokens == len(ids) and digests[i].round_trip for i, ids in coded.items())
    back = pieces.decode(spark.createDataFrame(list(coded.items()), "doc_id long, ids array<int>"), vocabulary, "doc_id")
    plain = {r.doc_id: r.text for r in back.collect()}
    for i, t in enumerate(texts):
        assert plain[i] == (pieces.SPACE + t.replace(" ", pieces.SPACE) if t else "")
    assert pieces.digest(df.limit(0), vocabulary).count() == 0


def test_unigram_fold_is_the_best_path(spark):
    rng = random.Random(5)
    own = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))): rng.uniform(-9, -1) for _ in range(25)}
    vocabulary = pieces.Vocabulary([(p, i + 3, s) for i, (p, s) in enumerate(own.items())], [], 0, False)
    words = ["".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    worst = max(-s for s in own.values()) + 10.0
    ids = {p: i + 3 for i, p in enumerate(own)}

    def cost(parts):
        return sum(-own[p] if p in own else (worst if len(p) == 1 else math.inf) for p in parts)

    def splits(w):
        return [[w]] + [[w[:k], *rest] for k in range(1, len(w)) for rest in splits(w[k:])]

    for r in pieces.encode_words(df, vocabulary).collect():
        best = min(cost(p) for p in splits(r.word))
        ways = [[ids.get(p, 0) for p in parts] for parts in splits(r.word) if abs(cost(parts) - best) < 1e-9]
        assert r.ids in ways


@needs_model
def test_long_words_merge_alike():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = pieces.load()
    ranks = {p: (s, i) for p, i, s in v.pieces}
    for w in ("international" * 9, "aaaa" * 40, "é東" * 50):
        assert pieces.merge_long(pieces.SPACE + w, ranks, v.bytes_, v.unknown) == library.encode(w)


@needs_model
def test_merges_in_order_are_those_of_the_heap():
    """The one pass over the edges, in plain Python, on words of all kinds against a heap of mergeable pairs."""
    v, rng = pieces.load(), random.Random(9)
    ranks = {p: (s, i) for p, i, s in v.pieces}
    sample = [p for p, _, _ in v.pieces if len(p) > 1]
    words = ["".join(rng.choice(sample) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    words += ["".join(rng.choice("aeinrst▁") for _ in range(rng.randrange(1, 64))) for _ in range(3000)]
    words += [pieces.SPACE * n for n in range(1, 64)]
    for w in words:
        edges = []
        for s in range(len(w)):
            for e in range(s + 2, min(len(w), s + v.longest) + 1):
                if w[s:e] in v.moments:
                    rank, offset, step = v.moments[w[s:e]]
                    edges.append((rank, s + offset, step, s, e))
        bounds = set(range(len(w) + 1))
        for *_, s, e in sorted(edges):
            if s in bounds and e in bounds:
                bounds -= set(range(s + 1, e))
        cuts = sorted(bounds)
        ids = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in ([ranks[w[a:b]][1]] if w[a:b] in ranks else [v.bytes_[c] for c in w[a:b].encode()])]
        assert ids == pieces.merge_long(w, ranks, v.bytes_, v.unknown), w


@needs_model
def test_words_around_the_longest_lattice(spark):
    v, rng = pieces.load(), random.Random(10)
    ranks = {p: (s, i) for p, i, s in v.pieces}
    words = {"".join(rng.choice("aeinrst▁é東") for _ in range(n)) for n in (58, 59, 60, 61, 62, 63, 64) for _ in range(8)}
    got = pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()
    assert {r.word: r.ids for r in got} == {w: pieces.merge_long(w, ranks, v.bytes_, v.unknown) for w in words}


@needs_model
def test_unigram_query_over_a_whole_table(spark, sf_dir, tmp_path):
    """The same pieces as a unigram model: Viterbi through the whole query, against the library's best scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for k, p in enumerate(model.pieces):
        p.score = -math.log(k + 1) - 1 if p.type == p.NORMAL else p.score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    score = {i: p.score for i, p in enumerate(model.pieces)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op9_pieces(spark, sf_dir, str(path)).collect()
    assert len(rows) == len(texts)
    same = 0
    for r in rows:
        want = library.encode(texts[r.doc_id] or "")
        assert r.round_trip and abs(sum(score[i] for i in r.ids) - sum(score[i] for i in want)) < 1e-3 * (1 + len(want))
        same += r.ids == want
    assert same >= 0.9 * len(rows)


# The pipeline


@needs_model
def test_pipeline_stages(spark, sf_dir):
    docs = corpus_pipeline.documents(spark, sf_dir)
    names = docs.columns
    assert [f for _, f in corpus_pipeline.STAGES] == [quality_rules.keep_good, ngram_join.keep_one, pii.redact, mixing.mix_documents, pieces.encode_documents]
    good = quality_rules.keep_good(spark, docs, sf_dir)
    assert good.columns == names and 0 < good.count() < docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1 and len((text[i] or "").split()) >= 10)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.round_trip and r.n_tokens >= r.n_words for r in rows) and {r.doc_id for r in rows} <= kept


@needs_model
def test_pipeline_of_odd_rows(spark, sf_dir):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, sf_dir)
            assert k == 4 or frame.columns == docs.columns
        frame.collect()


@needs_model
@pytest.mark.parametrize("frequent", [1, 40, pieces.FREQUENT])
def test_query_returns_ids_that_decode_to_each_document(spark, tmp_path, monkeypatch, frequent):
    import sentencepiece

    monkeypatch.setattr(pieces, "FREQUENT", frequent)
    monkeypatch.setattr(pieces, "TASK_ROWS", 3)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + ["the of rare1 the rare2 rare1", "of the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in pieces.op9_pieces(spark, str(tmp_path)).collect()}
    assert {i: r.ids for i, r in rows.items()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.values())


@needs_model
def test_a_document_that_decodes_to_another_text_does_not_round_trip(spark, monkeypatch):
    right = pieces.assembled
    monkeypatch.setattr(pieces, "assembled", lambda *a: right(*a).withColumn("ids", F.reverse("ids")))
    df = spark.createDataFrame([(1, "the end of it"), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in pieces.digest(df, pieces.load()).collect()} == {1: False, 2: True}


def test_ann_of_small_tables_finds_all_rows(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(10, 16)))]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 20).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [(a, b) for a in range(10) for b in range(10) if a != b]


def test_probes_prune_where_vectors_have_structure():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 64))
    x = centres[rng.integers(0, 100, 6000)] + 0.1 * rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 6000, 60)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    for tables in ann.TABLES:
        hashes = ann.Hashes.draw(64, 1.0, tables, 4)
        probes, buckets = hashes.probes(x[q], np.take_along_axis(scores, true[:, -1:], 1)[:, 0]), hashes.buckets(x)
        visited = np.stack([probes[t][:, buckets[t]] for t in range(tables)])
        assert visited.sum() < 0.2 * scores.size
        assert np.take_along_axis(visited.any(0), true, 1).mean() >= 0.9


def test_ann_of_scattered_queries_among_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    tight = centres[rng.integers(0, 20, 1840)] + 0.05 * rng.normal(size=(1840, 32))
    x = np.vstack([tight, rng.normal(size=(160, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x[rng.permutation(2000)])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 20).collect()
    recall = []
    for q, true in brute(rows, range(0, 2000, 10), 20).items():
        recall.append(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in true}) / 20)
    assert len(got) == 200 * 20 and min(recall) >= 0.5 and np.mean(recall) >= 0.9


def test_long_texts_are_taken_in_bounded_parts(spark, monkeypatch):
    real, limit = pieces.cut_words, 1 << 18

    def bounded(texts):
        assert len(texts) == 1 or sum(len(t.encode()) for t in texts.to_pylist() if t) <= limit
        return real(texts)

    monkeypatch.setattr(pieces, "cut_words", bounded)
    texts = ["some words of a long text " * 1000] * 40 + [None, "", "x" * (limit + 5), "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = pieces.digest(df, pieces.load()).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and all(r.round_trip for r in rows)
