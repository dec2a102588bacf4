"""Encoding, nearest vectors and dense numbering against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.operators import ranks, vector_index, vectors
from jobloom.plans import queries


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(i, f"title {i}", "" if i % 3 else "dept", f"summary  {i} words") for i in range(40)] + [(40, "", "", "")]
    return spark.createDataFrame(rows, "ord int, title string, department string, summary string").repartition(3)


def test_embed_with_encoder(jobs):
    def encode(texts):
        return np.array([[len(t), t.count("t"), t.count(" "), 0.0] for t in texts], dtype=np.float32)

    for r in vectors.embed(jobs, encode).collect():
        parts = [p for p in (r.title, r.title, r.title, r.department, r.summary) if p]
        v = encode([" ".join(parts)])[0].astype(np.float64)
        want = v / (np.linalg.norm(v) or 1)
        assert np.allclose(r.embedding, want, atol=1e-6)


def test_embed_default_is_unit_length(jobs):
    rows = {r.ord: r.embedding for r in vectors.embed(jobs).collect()}
    assert all(len(v) == vectors.DIMENSIONS for v in rows.values())
    for i, v in rows.items():
        assert abs(np.dot(v, v) - 1) < 1e-5
    assert rows[0] != rows[1]


@pytest.mark.parametrize("rows", [20_000, 70])
def test_similar_topk_is_exact(spark, rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(1)
    v[50] = v[60] = v[70]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(data, "id long, embedding array<float>").repartition(5)
    queries = df.where("id in (50, 7, 9, 11, 200)").withColumnRenamed("id", "query_id")
    got = {}
    for r in vectors.similar_topk(queries, df, 4, rows=rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    f = v.astype(np.float32).astype(np.float64)
    for q in (50, 7, 9, 11, 200):
        order = np.lexsort((np.arange(300), -(f @ f[q]).round(9)))[:4]
        assert [i for _, i in sorted(got[q])] == list(order)


def test_similar_topk_blocks_of_many_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    q = df.withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id) for r in vectors.similar_topk(q, df, 2, rows=25).collect()}
    scores = v.astype(np.float64) @ v.astype(np.float64).T
    assert got == {(i, int(j)) for i in range(120) for j in np.argsort(-scores[i])[:2]}


def _of_all_kinds():
    """Vectors in groups of equal and of nearly equal ones, some at random, some long, one of zeros."""
    rng = np.random.default_rng(6)
    near = np.repeat(rng.normal(size=(6, 24)), 20, axis=0) + 1e-4 * rng.normal(size=(120, 24))
    x = np.concatenate([np.repeat(near[:2], 60, axis=0), near, rng.normal(size=(160, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x, 3 * x[-20:], np.zeros((1, 24))])


@pytest.mark.parametrize("k,kind,unit", [(1, "float", True), (3, "float", True), (1, "double", False), (400, "float", True)])
def test_slices_give_what_blocks_give(spark, k, kind, unit):
    x = _of_all_kinds()[:400] if unit else _of_all_kinds()
    data = [(f"V{i:04d}", [float(a) for a in r]) for i, r in enumerate(np.random.default_rng(2).permutation(x))]
    df = spark.createDataFrame(data, f"id string, embedding array<{kind}>").repartition(4).cache()
    q = df.withColumnRenamed("id", "query_id")
    want = {(r.query_id, r["rank"]): (r.id, r.score) for r in vectors._ranked(vectors._blockwise(q, df, k, 1, 1), k).collect()}
    found = [vectors.similar_topk(q, df, k, rows=60)]
    if k == 1 and unit:  # that route, not the one for vectors far from all others
        sliced = vectors._sliced(q, df, k, 60)
        assert sliced is not None
        found.append(vectors._ranked(sliced, k))
    for got in ({(r.query_id, r["rank"]): (r.id, r.score) for r in f.collect()} for f in found):
        assert got.keys() == want.keys()
        # ids may trade places where scores are equal but for their last digit
        assert all(abs(got[x][1] - want[x][1]) < 1e-12 for x in want)
        assert sum(got[x][0] != want[x][0] for x in want) == 0 or k == 400
    df.unpersist()


def test_slices_of_far_vectors_are_met_as_blocks(spark):
    x = np.random.default_rng(8).normal(size=(150, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    assert vectors._sliced(df.withColumnRenamed("id", "query_id"), df, 3, 20) is None
    one = df.withColumn("embedding", F.when(F.col("id") == 3, F.transform("embedding", lambda x: x * float("inf"))).otherwise(F.col("embedding")))
    assert vectors._sliced(one.withColumnRenamed("id", "query_id"), one, 1, 20) is None


def test_reach_of_own_vector():
    """A unit vector that is its own nearest needs no row farther than rounding; without k rows nothing is ruled out."""
    x = np.random.default_rng(9).normal(size=(1000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    low, square = vectors._places(x)
    order = np.argsort(low[:, 0])
    x, low, square = x[order], low[order], square[order]
    assert vectors._reach(x, low, square, x, low, 1, square.max()).max() < 2e-3
    assert np.isinf(vectors._reach(x, low, square, x[:3], low[:3], 4, square.max())).all()


def test_dense_index(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 10).alias("g"))
    rows = ranks.dense_index(df.repartition(6), [F.col("k").desc()]).collect()
    assert sorted(r.row_index for r in rows) == list(range(1000)) and all(r.k == 999 - r.row_index for r in rows)
    last = {r.id: r.row_index for r in ranks.row_index(df, "g", ["k", "id"]).collect()}
    want = {}
    for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id))):
        want[r.g] = i
    assert last == want


def test_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    assert vectors.similar_topk(df.where("id > 5").withColumnRenamed("id", "query_id"), df, 2).count() == 0


def test_no_queries_with_text_ids(spark):
    df = spark.createDataFrame([("P1", [1.0])], "id string, embedding array<float>")
    assert vectors.similar_topk(df.where("id = 'P5'").withColumnRenamed("id", "query_id"), df, 2).collect() == []


def test_published_search_asks_every_job(spark, tmp_path, monkeypatch):
    """Every published job is a query, and all published vectors are searched."""
    docs = [(i, f"title {i} word{i % 13}", "en", f"src{i % 7}", 10) for i in range(1, 260)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    searched, topk = [], vectors.similar_topk
    monkeypatch.setattr(vectors, "similar_topk", lambda q, v, *rest: searched.append((q.count(), v.count())) or topk(q, v, *rest))
    found = queries.publish_and_search(spark, str(tmp_path)).collect()
    ids = sorted(r.id for r in queries._site(spark, str(tmp_path)).collect())
    assert len(ids) > 200 and searched == [(len(ids), len(ids))]
    assert sorted(r.query_id for r in found) == ids
    assert all(abs(r.score - 1) < 1e-4 for r in found)


def test_text_ids_ties_and_missing_order(spark):
    df = spark.createDataFrame([("P1", [1.0, 0.0], 1), ("P2", [0.0, 1.0], 1), ("P10", [1.0, 0.0], None), ("P3", [0.6, 0.8], 2)],
                               "id string, embedding array<float>, ord int")
    found = vectors.similar_topk(df.where("id = 'P1'").withColumnRenamed("id", "query_id"), df, 3).collect()
    assert [(r.query_id, r.id) for r in sorted(found, key=lambda r: r["rank"])] == [("P1", "P1"), ("P1", "P10"), ("P1", "P3")]
    numbered = {r.id: r.row_index for r in vectors.with_row_index(df, ["ord"]).collect()}
    assert sorted(numbered.values()) == [0, 1, 2, 3] and numbered["P10"] == 0 and numbered["P3"] == 3


def _clustered(spark, seed=5, copies=400):
    """Unit vectors round 20 directions, and one vector in many copies."""
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(20, 16))[rng.integers(0, 20, 800)] + 0.3 * rng.normal(size=(800, 16))
    x = np.concatenate([near, np.repeat(near[:1], copies, axis=0)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(a) for a in r], "extra") for i, r in enumerate(x)] + [(5000, None, "null")]
    return spark.createDataFrame(rows, "id long, embedding array<float>, list string").repartition(3)


def test_index_finds_nearest(spark):
    df = _clustered(spark)
    asked = df.where("id % 50 = 1 or id = 5000").select(F.col("id").alias("query_id"), "embedding")
    exact = vectors.similar_topk(asked.where("embedding is not null"), df.where("embedding is not null"), 5)
    # small blocks: the list of copies is dealt to many
    found = vector_index.similar_indexed(asked, df, 5, probes=8, rows=100)
    measured = vector_index.recall(found, exact).first()
    assert measured.queries == 24 and measured.wanted == 120 and measured.recall >= 0.9
    everything = vector_index.similar_indexed(asked, df, 5, lists=12, probes=12, rows=100)
    rows = lambda d: {(r.query_id, r.id, r["rank"], round(r.score, 6)) for r in d.collect()}
    assert rows(everything) == rows(exact)


def test_index_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    asked = df.withColumnRenamed("id", "query_id")
    assert vector_index.similar_indexed(asked, df, 3).count() == 0
    assert vector_index.similar_indexed(asked.limit(0), df.limit(0), 3).columns == ["query_id", "id", "score", "rank"]
