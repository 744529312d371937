import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import retrieve as rt
from parley.operators.embed import hashed_embedder


def _vecs(spark, m, name_id, name_vec):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name_id} long, {name_vec} array<float>")


def test_blocked_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 8)).astype(np.float32)
    c[5] = c[6]                                  # exact ties
    c[100:130] = c[7]
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = c[:40]
    s = q.astype(np.float64) @ c.astype(np.float64).T
    old = rt.MAX_BROADCAST_QUERIES
    for limit in (0, old):          # blocked grid, then broadcast scan
        rt.MAX_BROADCAST_QUERIES = limit
        try:
            got = rt.blocked_topk(_vecs(spark, q, "query_id", "qvec"), _vecs(spark, c, "id", "vec").repartition(3), 5,
                                  block_rows=37, query_block_rows=9).collect()
        finally:
            rt.MAX_BROADCAST_QUERIES = old
        got = {(r["query_id"], r["rank"]): r["id"] for r in got}
        for i in range(len(q)):
            order = sorted(range(len(c)), key=lambda j: (-round(s[i, j], 9), j))[:5]
            assert [got[(i, r + 1)] for r in range(5)] == order
    with pytest.raises(ValueError):
        rt.blocked_topk(_vecs(spark, q, "query_id", "qvec"), _vecs(spark, c, "id", "vec"), 0)


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    store = e.select(F.col("vec_id").alias("id"), "embedding")
    exact = {(r["query_id"], r["id"]) for r in rt.knn(q, store, 6, with_payload=False).collect()}
    full = {(r["query_id"], r["id"]) for r in rt.knn_approx(q, store, 6, nlist=22, nprobe=1000).collect()}
    assert full == exact
    found = {(r["query_id"], r["id"]) for r in rt.knn_approx(q, store, 6).collect()}      # probes by measured recall
    assert len(exact & found) >= 0.9 * len(exact)


def _clusters(n, dim, around, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(around, dim))
    x = centres[rng.integers(0, around, n)] + 0.05 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_pruned_topk_skips_cells_and_is_exact(spark):
    c = _clusters(600, 12, 9, 4)
    c[:80] = c[0]                                # a crowd of equal vectors
    q = np.concatenate([c[:40], _clusters(20, 12, 4, 5)])
    q[50] = 0
    corpus, queries = _vecs(spark, c, "id", "vec").repartition(3).cache(), _vecs(spark, q, "query_id", "qvec")
    s = q.astype(np.float64) @ c.astype(np.float64).T
    want = {(i, n + 1): j for i in range(len(q)) for n, j in enumerate(sorted(range(len(c)), key=lambda j: (-round(s[i, j], 9), j))[:7])}
    cells = rt.quantise(corpus, 30)
    few = rt.given_cells(corpus.filter("id < 3").select(F.col("id").alias("cell"), "vec"))
    for given in (cells, few):
        got = rt.pruned_topk(queries, corpus, 7, given, block_rows=50, query_block_rows=16).collect()
        assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    assigned = rt.assign_cells(corpus, cells)
    n_cells = assigned.select("cell").distinct().count()
    _first, rest = rt.cells_that_matter(queries, assigned, cells, 7)
    skipped = 1 - (rest.count() + len(q)) / (len(q) * n_cells)
    assert skipped > 0.5 and n_cells >= 9, (skipped, n_cells)
    assert rt.pruned_topk(queries, corpus.limit(0), 7).count() == 0
    old = rt.MAX_BROADCAST_CELL_FLOATS
    rt.MAX_BROADCAST_CELL_FLOATS = 24            # centroids that go to no task
    try:
        joined = {r["id"]: r["cell"] for r in rt.assign_cells(corpus, cells).collect()}
        got = rt.pruned_topk(queries, corpus, 7, cells, block_rows=50, query_block_rows=16).collect()
    finally:
        rt.MAX_BROADCAST_CELL_FLOATS = old
    assert joined == {r["id"]: r["cell"] for r in assigned.collect()}
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want


def test_cosine_and_overlap(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], "a b c", "b c d"), ([0.0, 0.0], [1.0, 0.0], "", "")],
                               "a array<float>, b array<float>, q string, t string")
    r = df.select(rt.cosine("a", "b").alias("c"), rt.token_overlap(F.col("q"), F.col("t")).alias("o")).collect()
    assert abs(r[0]["c"] - 2 ** -0.5) < 1e-9 and r[0]["o"] == 0.5
    assert r[1]["c"] == 0.0 and r[1]["o"] == 0.0


def _store(spark, texts, dim=32):
    emb = hashed_embedder(dim)
    df = spark.createDataFrame([(f"id{i}", t, i + 1) for i, t in enumerate(texts)], "id string, text string, line long")
    return df.select("id", "text", emb(F.col("text")).alias("embedding"),
                     F.struct(F.col("line"), F.lit("f").alias("source")).alias("metadata"))


def test_rerank_keeps_metadata_and_orders(spark):
    store = _store(spark, ["red apple pie", "green apple", "blue sky", "apple"])
    q = spark.createDataFrame([("q1", "apple pie")], "query_id string, query string")
    emb = hashed_embedder(32)
    hits = rt.retrieve(q, store, k=3, rerank_hits=True, rerank_top_k=4, embedder=emb).orderBy("rank").collect()
    assert len(hits) == 3
    scores = [h["rerank_score"] for h in hits]
    assert scores == sorted(scores, reverse=True)
    assert all(h["metadata"]["source"] == "f" for h in hits)
    plain = rt.retrieve(q, store, k=2, embedder=emb).collect()
    assert len(plain) == 2 and "rerank_score" not in plain[0].asDict()


def test_export_retrieval(spark):
    corpus = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(["one fish", "two fish", "red fish"])],
                                   "source string, line_no long, text string")
    store = _store(spark, ["one fish", "two fish", "red fish"])
    e = hashed_embedder(32)
    allq = rt.export_retrieval(corpus, store, samples=10, k=2, seed=1, embedder=e)
    assert allq.count() == 3 and all(len(r["results"]) == 2 for r in allq.collect())
    assert rt.export_retrieval(corpus, store, samples=0, k=2, embedder=e).count() == 0
    two = rt.export_retrieval(corpus, store, samples=2, k=1, seed=5, embedder=e)
    assert two.count() == 2
    ex = rt.export_retrieval(corpus, store, queries=["red", "  ", "two"], k=1, embedder=e).orderBy("query_id").collect()
    assert [r["query"] for r in ex] == ["red", "two"]
    assert ex[0]["results"][0]["text"] == "red fish"
    assert rt.export_retrieval(corpus, store, queries=["  "], k=1, embedder=e).count() == 0


def test_sample_and_first(spark):
    corpus = spark.createDataFrame([("f", i, str(i)) for i in range(1, 21)], "source string, line_no long, text string")
    a = [r["line_no"] for r in rt.sample_messages(corpus, 5, 7).collect()]
    b = [r["line_no"] for r in rt.sample_messages(corpus.repartition(4), 5, 7).collect()]
    assert a == b and len(set(a)) == 5
    assert rt.sample_messages(corpus, 50, 7).count() == 20
    assert rt.sample_messages(corpus, -1, 7).count() == 0
    assert sorted(r["line_no"] for r in rt.first_messages(corpus.repartition(3), 3).collect()) == [1, 2, 3]


def test_export_fail_on_empty(spark):
    corpus = spark.createDataFrame([], "source string, line_no long, text string")
    store = _store(spark, ["x"])
    with pytest.raises(ValueError):
        rt.export_retrieval(corpus, store, samples=3, fail_on_empty=True)
    c2 = spark.createDataFrame([("f", 1, "x")], "source string, line_no long, text string")
    with pytest.raises(ValueError):
        rt.export_retrieval(c2, store, queries=[" "], fail_on_empty=True)


def test_large_search_lists_no_query_and_cell_pairs(spark, monkeypatch):
    c = _clusters(400, 8, 5, 11)
    c[:60] = c[1]                                # a crowd of equal vectors
    q = np.concatenate([c[:30], c[:5]])
    names = [*range(30), *range(5)]              # query ids that repeat
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(names, q)], "query_id long, qvec array<float>")
    corpus = _vecs(spark, c, "id", "vec").repartition(3)
    s = q.astype(np.float64) @ c.astype(np.float64).T
    want = {}
    for i in range(30):
        found = sorted((-round(s[n, j], 9), j) for n in range(len(q)) if names[n] == i for j in range(len(c)))[:4]
        want |= {(i, r + 1): j for r, (_, j) in enumerate(found)}

    def listed(*_args, **_kw):
        raise AssertionError("a row per query and cell")

    monkeypatch.setattr(rt, "cells_that_matter", listed)
    monkeypatch.setattr(rt, "MAX_BROADCAST_QUERIES", 0)
    got = rt.blocked_topk(queries, corpus, 4, block_rows=40, query_block_rows=2).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    got = rt.blocked_topk(queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")), corpus, 4, block_rows=40, query_block_rows=2).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    monkeypatch.undo()
    store = corpus.select("id", F.col("vec").alias("embedding"))
    once = queries.filter("query_id >= 5")
    monkeypatch.setattr(rt, "topk_in_cells", listed)
    near = rt.knn_approx(once, store, 4, nlist=6, nprobe=100).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in near} == {at: j for at, j in want.items() if at[0] >= 5}


def test_sparse_vectors_are_scored_by_short_bounds():
    import pyarrow as pa
    rng = np.random.default_rng(8)
    dim, k = 384, 4

    def words(n):                                # word counts, as of the hashed embedder
        x = np.zeros((n, dim), np.float32)
        for row in x:
            np.add.at(row, (dim * rng.random(rng.integers(3, 40)) ** 2).astype(int), 1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    c, q = words(6000), words(300)
    c[3000:3020] = c[17]                         # exact ties
    q[:60] = c[:60]
    q[100:103] = 0                               # every score is a tie
    s = np.round(q.astype(np.float64) @ c.astype(np.float64).T, 9)
    place, cell = rng.permutation(len(c)), np.sort(rng.integers(0, 9, len(c)))
    floor = np.full(len(q), -np.inf)
    floor[:150] = -np.partition(-s[:150, :500], k - 1, axis=1)[:, k - 1]
    want = np.array([np.lexsort((place, -row))[:k] for row in s])
    best = rt._Best(k, pa.array(range(len(q))), q, floor)
    for at in range(0, len(c), 1000):
        part = slice(at, at + 1000)
        best.add(pa.array(range(at, at + 1000)), c[part], cell[part], place[part], 250)
    assert best.fold is not None and best.fold.width < dim
    assert (best.row == want).all()
    # bounds never lie below a score
    for fold in best.folds:
        assert (fold(q) @ fold(c).T + 1e-5 > s).all()
    # only the cells that a query probes
    some = rt._Best(k, pa.array(range(len(q))), q, np.full(len(q), -np.inf))
    probe = rng.random((9, len(q))) < 0.4
    probe[0] = True
    for at in range(0, len(c), 1000):
        part = slice(at, at + 1000)
        some.add(pa.array(range(at, at + 1000)), c[part], cell[part], place[part], 250, lambda name: probe[name])
    masked = np.where(probe[cell].T, s, -np.inf)
    assert (some.row == np.array([np.lexsort((place, -row))[:k] for row in masked])).all()


def test_equal_vectors_are_found_by_their_hash(spark):
    c = np.concatenate([np.tile([[0.6, 0.8]], (50, 1)), np.random.default_rng(1).normal(size=(40, 2))])
    left = rt._first_of_equals(_vecs(spark, c, "id", "vec").repartition(3), 4)
    assert sorted(r["id"] for r in left.collect()) == [0, 1, 2, 3, *range(50, 90)]
    plain = _vecs(spark, c[50:], "id", "vec")
    assert rt._first_of_equals(plain, 4) is plain


def test_rerank_of_many_queries_splits_texts_once(spark, monkeypatch):
    texts = ["red apple pie", "green apple", "blue sky", "apple", "pie pie red", "!!", "sky apple"]
    store, emb = _store(spark, texts), hashed_embedder(32)
    q = spark.createDataFrame([("q1", "apple pie"), ("q3", "?")], "query_id string, query string")
    ask = dict(k=3, rerank_hits=True, rerank_top_k=6, embedder=emb)
    few = rt.retrieve(q, store, **ask)
    want = {(r["query_id"], r["rank"], r["id"], r["score"], r["text"], r["rerank_score"]) for r in few.collect()}
    monkeypatch.setattr(rt, "MAX_BROADCAST_QUERIES", 0)
    many = rt.retrieve(q, store, **ask)
    assert {(r["query_id"], r["rank"], r["id"], r["score"], r["text"], r["rerank_score"]) for r in many.collect()} == want
    assert many.columns == few.columns
    plan = many.select("query_id", "rank", "id", "rerank_score")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Join")]
    assert "regexp_extract_all" not in top and plan.count("regexp_extract_all") == 2, plan
    longest = rt.retrieve(q.filter("query_id = 'q1'"), store, k=2, rerank_hits=True, rerank_top_k=7, embedder=emb,
                          scorer=lambda _q, text: F.char_length(text)).orderBy("rank").collect()
    assert [r["text"] for r in longest] == ["red apple pie", "pie pie red"]
