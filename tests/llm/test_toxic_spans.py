import itertools
import zlib

import numpy as np
import pytest

from jobloom.llm import toxic_spans as X

DOCS = "doc_id long, text string, score string, spans int, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def brute(emission, first, transition, start):
    """Every tag sequence of every document."""
    p, edges = np.zeros(len(emission)), [*np.flatnonzero(first), len(emission)]
    for a, b in zip(edges, edges[1:]):
        total = 0.0
        for tags in itertools.product((0, 1), repeat=b - a):
            w = start[tags[0]] + sum(transition[x][y] for x, y in zip(tags, tags[1:])) + sum(e for e, t in zip(emission[a:b], tags) if t)
            total += np.exp(w)
            p[a:b] += np.exp(w) * np.array(tags)
        p[a:b] /= total
    return p


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    for block in (1, 3, 64):
        monkeypatch.setattr(X, "BLOCK", block)
        for _ in range(10):
            sizes = rng.integers(1, 8, 5)
            first = np.zeros(sizes.sum(), bool)
            first[np.cumsum(sizes) - sizes] = True
            emission, transition, start = rng.normal(size=len(first)) * 3, rng.normal(size=(2, 2)), rng.normal(size=2)
            assert np.allclose(X.marginals(emission, first, transition, start), brute(emission, first, transition, start))


def test_gradient_of_pairs():
    rng = np.random.default_rng(2)
    first = np.array([True, False, False, True, False])
    e, t, s = rng.normal(size=5), rng.normal(size=(2, 2)), rng.normal(size=2)

    def log_z(t):
        total = 0.0
        for a, b in ((0, 3), (3, 5)):
            total += np.log(sum(np.exp(s[g[0]] + sum(t[x][y] for x, y in zip(g, g[1:])) + sum(v for v, k in zip(e[a:b], g) if k))
                                for g in itertools.product((0, 1), repeat=b - a)))
        return total

    _, both = X.marginals(e, first, t, s, pairs=True)
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert both[i, j] == pytest.approx((log_z(t + d) - log_z(t - d)) / 2e-6, abs=1e-5)


def corpus():
    rng = np.random.default_rng(4)
    plain = ["river", "stone", "bridge", "window", "market", "garden", "letter", "winter", "paper", "music"]
    docs, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            words[7], words[20] = "vile,", "Scummy"
        docs.append((i, " ".join(words), "", 0, 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_scores_spans_and_edges(spark):
    docs, labels = corpus()
    extra = [(1000, None, None, None, None), (1001, "", "", 0, 0), (1002, "a  scummy\nriver vile", "", 0, 0), (None, "stone river music", "", 0, 0),
             (1002, "a  scummy\nriver vile", "", 0, 0), (1003, "stone " * 9000 + "vile " + "river " * 9000, "", 0, 0)]
    got = X.toxic_spans(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], LABELS)).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    for i, _, bad in labels:
        assert by[i].predicted == bad and by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert by[1002].predicted == 1 and [(s.start, s.end) for s in by[1002].spans] == [(3, 9), (16, 20)]
    assert by[1000].score == by[1001].score < 0.5 and by[1000].spans == [] and by[None].predicted == 0
    assert [(s.start, s.end) for s in by[1003].spans] == [(54000, 54004)]
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], LABELS)
    got = X.toxic_spans(spark.createDataFrame([(1, "some words", "", 0, 0)], DOCS), none).collect()
    assert [(r.score, r.predicted, r.spans) for r in got] == [(0.5, 0, [])]
    assert X.toxic_spans(spark.createDataFrame([], DOCS), none).count() == 0


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = X.toxic_spans(docs, labels, 400, 800).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.8 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
