import random

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, share int, n_chars long"
ITEMS = "item_id long, text string, doc_id string"


def test_words():
    w = D.words_of(pa.array(["The cat, (the) CAT! -- '", None, "", "cat's", "...", "Été the"]))
    assert np.diff(w.edges).tolist() == [4, 0, 0, 1, 0, 2]
    assert w.prints[0] == w.prints[2] == w.prints[6] and w.prints[1] == w.prints[3] != w.prints[4]


def test_common_subsequence_equals_brute_force():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.common_subsequence(a, b) == table[-1][-1]


def test_svd_equals_dense(spark, monkeypatch):
    monkeypatch.setattr(D, "RANK", 6)
    monkeypatch.setattr(D, "ROUNDS", 6)
    r = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    texts = [" ".join(r.choices(topics[i % 6], k=40)) for i in range(90)]
    idf = np.ones(D.FEATURES, np.float32)
    latent = D.fit(spark.createDataFrame([(t, 1.0) for t in texts], "text string, weight double").repartition(3), idf)
    row, feature, value, n = D.passages(pa.array(texts), np.ones(len(texts)), idf)
    used, place = np.unique(feature, return_inverse=True)
    dense = np.zeros((n, len(used)))
    dense[row, place] = value
    right, sizes = np.linalg.svd(dense, full_matrices=False)[2][:6], np.linalg.svd(dense, compute_uv=False)[:6]
    want = (right / sizes[:, None]).T
    got = latent[used]
    # equal up to the signs of the directions
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


def story(r, n):
    return [r.choice(["the", "of", "and", "to"]) if r.random() < 0.3 else f"w{r.randrange(3000)}" for _ in range(n)]


def test_planted_leaks(spark):
    r = random.Random(4)
    items = [(i, " ".join(story(r, r.choice([12, 20, 35, 55])))) for i in range(30)] + [(30, None), (31, ""), (32, "short w5 one"), (None, " ".join(story(r, 25)))]
    docs, want = [], set()
    for i in range(200):
        words = story(r, r.choice([3, 60, 300, 2000]))
        if i % 4 == 0:
            item = items[i % 30][1].split()
            if i % 8 == 0:  # reworded: a word in seven is another one
                item = [f"x{k}" if k % 7 == 3 else w for k, w in enumerate(item)]
            at = r.randrange(len(words))
            words[at:at] = item
            want.add((i, i % 30))
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "well, a SHORT w5 one. it is"), (503, "short of w5 the one"), (None, items[3][1]), (4, docs[4][1]), (504, items[33][1].upper())]
    want |= {(502, 32), (None, 3), (504, None)}
    df = spark.createDataFrame([(i, t, "", 0, 0) for i, t in docs], DOCS)
    got = D.benchmark_leaks(df, spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + 1
    for x in got:
        text = D.common.WORDS.findall(dict(docs)[x.doc_id])
        if x.item_id is not None:
            assert len(set(text[x.first_word:x.last_word]) & set(items[x.item_id][1].split())) >= 1 or x.doc_id == 502
    kept = D.decontamination_stage(spark, df, _folder(spark, items))
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {a for a, _ in want})


def test_copies_of_any_length(spark):
    r = random.Random(8)
    items = [(n, " ".join(f"i{n}x{r.randrange(4000)}" if n > 7 else f"s{n}w{i}" for i in range(n)), "") for n in (1, 2, 3, 5, 7, 8, 290, 301, 700, 1500, 7000)]
    docs, want = [], set()
    for n, text, _ in items:
        for k, (before, after) in enumerate(((0, 0), (37, 950), (2600, 11))):
            docs.append((10 * n + k, " ".join([*story(r, before), text.upper(), *story(r, after)]), "", 0, 0))
            want.add((10 * n + k, n))
    # a fifth of the words are others; a third of the item alone is no leak; nor are parts of short ones
    long = items[-1][1].split()
    docs.append((1, " ".join(story(r, 500) + [w if i % 5 else f"y{i}" for i, w in enumerate(long)] + story(r, 500)), "", 0, 0))
    docs.append((2, " ".join(story(r, 500) + long[2000:4300] + story(r, 500)), "", 0, 0))
    docs.append((3, "s3w0 s3w1 and s3w2", "", 0, 0))
    want.add((1, 7000))
    docs += [(100_000 + i, " ".join(story(r, 400)), "", 0, 0) for i in range(40)]
    got = D.benchmark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    texts = {d[0]: d[1].lower().split() for d in docs}
    for x in got:
        item = items[[i[0] for i in items].index(x.item_id)][1].split()
        passage = texts[x.doc_id][x.first_word:x.last_word]
        assert passage == item if x.item_id < 8 else len(set(passage) & set(item)) >= 0.75 * len(set(item))


def _folder(spark, items):
    from jobloom.session import fresh_path

    path = fresh_path(spark, "leak-test")
    spark.createDataFrame([(i, t, "") for i, t in items], ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("passes", [1, 3])
def test_given_tables(spark, monkeypatch, passes):
    base = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(D, "ITEMS_PER_PASS", -(-items.count() // passes))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(d, b.item_id) for b in items.collect() for d, t in texts if b.text in t}
    got = {(r.doc_id, r.item_id) for r in D.benchmark_leaks(docs, items).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 1


def test_space_is_fitted_on_all_documents(spark, monkeypatch):
    fitted, fit = [], D.fit
    monkeypatch.setattr(D, "fit", lambda rows, idf, *rest: fitted.append(rows.collect()) or fit(rows, idf, *rest))
    docs = [(i, f"w{i} and w{i + 1} of w{i + 2}" if i % 100 else None, "", 0, 0) for i in range(4500)] + [(1, "w1 and w2 of w3", "", 0, 0)]
    items = [(1, "a b c d e f g h i j", "")]
    D.benchmark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(r.text for r in fitted[0]) == sorted([d[1] for d in docs if d[1]] + [items[0][1]])


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c", "", 0, 0)], DOCS)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.benchmark_leaks(some, no_items).count() == 0
    assert D.benchmark_leaks(none, spark.createDataFrame([(1, "a b c", "")], ITEMS)).count() == 0


def test_fit_reads_the_written_features(spark):
    r = random.Random(3)
    texts = [" ".join(story(r, n)) for n in (0, 1, 48, 49, 500, 3000)] + ["-- a, b! ...", None]
    rows = spark.createDataFrame([(t, 1.0 + i) for i, t in enumerate(texts)], "text string, weight double")
    words = D.feature_rows(rows)
    got = sorted((x.weight, bytes(x.words)) for x in words.collect())
    assert [np.frombuffer(w, "<u2").tolist() for _, w in got] == [D.features(D.words_of(pa.array([t], pa.string())).prints).tolist() for t in texts]
    idf = np.linspace(1, 2, D.FEATURES).astype(np.float32)
    unread = rows.selectExpr("raise_error(text) AS text", "weight")
    assert np.allclose(D.fit(unread, idf, words), D.fit(rows, idf), rtol=1e-3, atol=1e-4)
    frequency, n = D.document_frequencies(words)
    assert n == len(texts) and frequency.sum() == sum(len(set(np.frombuffer(w, "<u2").tolist())) for _, w in got)


def test_product_of_passages_together():
    r = random.Random(6)
    texts = pa.array([" ".join(story(r, n)) for n in (0, 700, 3, 0, 48, 1999)])
    row, feature, value, n = D.passages(texts, np.arange(1.0, 7.0), np.ones(D.FEATURES, np.float32))
    dense = np.zeros((n, D.FEATURES))
    dense[row, feature] = value
    right = np.random.default_rng(0).normal(size=(D.FEATURES, 5)).astype(np.float32)
    total = np.ones((D.FEATURES, 5), np.float32)
    D.add_product(total, row, feature, value, n, right)
    assert np.allclose(total, 1 + dense.T @ (dense @ right), atol=1e-3)
    assert np.array_equal(np.unique(row), np.arange(n)) and np.allclose((dense ** 2).sum(axis=1), [4] * 15 + [9] + [25] + [36] * 42)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100])
def test_running_sums(n):
    rows = np.random.default_rng(n).normal(size=(n, 3)).astype(np.float32)
    assert np.allclose(D.running_sums(rows), np.concatenate([np.zeros((1, 3)), np.cumsum(rows, axis=0)]), atol=1e-4)


def test_stage_takes_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sizes, saved = spark.conf.get(key), [], D.common.saved
    monkeypatch.setattr(D.common, "saved", lambda *rest: sizes.append(spark.conf.get(key)) or saved(*rest))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "", 0, 0), (2, "other words", "", 0, 0)], DOCS)
    kept = D.decontamination_stage(spark, docs, _folder(spark, [(1, "a b c d e f g h i j")]))
    assert [r.doc_id for r in kept.collect()] == [2]
    assert sizes == [str(D.common.BATCH_BYTES)] * 2 and spark.conf.get(key) == before
    rows = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 2000) AS text")
    many = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    with D.common.small_batches(spark):
        assert max(r.n for r in rows.mapInArrow(many, "n long").collect()) < 1500
