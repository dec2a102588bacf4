"""Operator 13: features by hand, risk and prior on known mixtures, held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, predicted int, positive string"


def test_features_by_hand():
    texts = ["Go go  GO! x1$\nx1$", None, "", " \n", "é", "a" * 50, "Wort Wort"]
    f = Q.features(pa.array(texts))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        words = data.split()
        kinds = Q.KINDS[list(data)].tolist()
        mine = f.row == i
        runs = Counter((kinds[k] * 8 + kinds[k + 1]) * 8 + kinds[k + 2] for k in range(len(kinds) - 2))
        got = Counter()
        for slot, value in zip(f.slot[mine], f.value[mine]):
            got[int(slot)] += value
        assert {s - Q.STYLE: pytest.approx(Q.WEIGHT * n / sum(runs.values())) for s, n in ((s + Q.STYLE, n) for s, n in runs.items())} == {
            s - Q.STYLE: v for s, v in got.items() if s < Q.STYLE + Q.RUNS}
        assert sum(v for s, v in got.items() if s >= Q.STYLE + Q.RUNS) == pytest.approx(Q.WEIGHT if words else 0)
        again = sum(a.lower() == b.lower() for a, b in zip(words, words[1:]))
        n = max(len(words), 1)
        style = f.style[i]
        assert style[8] == pytest.approx(Q.WEIGHT * again / n) and style[9] == pytest.approx(Q.WEIGHT * len({w.lower() for w in words}) / n)
        assert style[13] == (not words) and style[11] == pytest.approx(Q.WEIGHT * sum(w[-1:] == b"$" for w in words) / n)


def mixture(prior, n_p=3000, n_u=4000, seed=0, apart=3.0):
    """Positives around +apart, negatives around -apart, one feature and a constant."""
    r = np.random.default_rng(seed)
    truth = np.concatenate([np.ones(n_p), r.random(n_u) < prior]).astype(bool)
    x = np.where(truth, apart, -apart) + r.standard_normal(n_p + n_u)
    order = r.permutation(n_p + n_u)
    x, truth, positive = x[order], truth[order], (np.arange(n_p + n_u) < n_p)[order]
    n = len(x)
    return Q.Sample(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.column_stack([np.ones(n), x]).ravel(), positive, ~positive), truth


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_and_risk(prior):
    s, truth = mixture(prior)
    found = Q.class_prior(s)
    assert abs(found - prior) < 0.06
    w = Q.train(s, found)
    assert ((s.scores(w) > 0) == truth).mean() > 0.98
    # the unbiased risk is that of the true labels
    w = np.zeros(Q.WIDTH)
    w[:2] = [0.3, 0.4]
    scores, u = s.scores(w), s.unlabelled
    want = np.where(truth[u], np.logaddexp(0, -scores[u]), np.logaddexp(0, scores[u])).mean()
    assert sum(Q.risk(scores, s, prior)) == pytest.approx(want, abs=0.03)


def test_step_where_the_risk_of_negatives_is_below_zero():
    # a prior far too large: the negatives' part would fall without end, and does not
    s, _ = mixture(0.2)
    w = Q.train(s, 0.9, steps=400)
    assert Q.risk(s.scores(w), s, 0.9)[1] > -0.05


def test_held_out_labels(spark):
    rows = {r.doc_id: r for r in Q.op13_quality_classifier(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert set(rows) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    good = np.array([rows[r.doc_id].score for r in labels if r.quality == 1 and rows[r.doc_id].held_out])
    bad = np.array([rows[r.doc_id].score for r in labels if r.quality == 0 and rows[r.doc_id].held_out])
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (good >= 0.5).mean() > 0.95


def test_odd_rows(spark):
    good = [(i, f"A quiet sentence about thing {i} and some more of it.", "a", 1, "b") for i in range(60)]
    bad = [(100 + i, "BUY BUY BUY $$$ ### !!! " * 5, "a", 1, "b") for i in range(30)]
    odd = [(None, "A quiet sentence.", "a", 1, "b"), (900, None, None, None, None), (901, "", "a", 1, "b"), (902, "long text here " * 50_000, "a", 1, "b")]
    docs = spark.createDataFrame(good + bad + odd + good[:1] * 40, SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(30)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rows = Q.quality_scores(docs.repartition(3), labels).collect()
    assert len(rows) == 134 and all(0 <= r.score <= 1 for r in rows)
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and scores[900] == scores[901]
    assert min(min(scores[i]) for i in range(60)) > max(max(scores[100 + i]) for i in range(30))
    sample = Q.sample(docs, labels, 5, 7)
    assert len(sample.positive) <= 12 and sample.positive.sum() <= 5 + 40
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).collect() == []
