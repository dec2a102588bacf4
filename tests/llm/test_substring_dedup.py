import hashlib
import random
from collections import Counter

import numpy as np

from jobloom.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, uid string, runs int, first string"


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((doc, len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def answers(spark, rows, length, **more):
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in S.remove_repeats(df.repartition(3), length, **more).collect()), key=str)


def corpus(seed, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(r.randint(5, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = "".join(r.choice([word, word, word, lambda: r.choice(passages)])() for _ in range(r.randint(0, 25)))
        if rows and r.random() < 0.3:
            text = list(r.choice(rows)[1])
            for _ in range(r.randint(0, 3)):
                if text:
                    text[r.randrange(len(text))] = "#"
            text = "".join(text)
        rows.append((i, text))
    return rows


EDGES = [(900, None), (901, ""), (902, "short"), (903, "ab" * 300), (904, "x" * 500), (None, "null id " * 3), (905, "q" * 60), (906, "q" * 61), (907, "é" * 100)]


def test_equals_brute_force(spark):
    assert answers(spark, corpus(1) + EDGES + [(3, "the same row twice, long enough to be found again " * 2)] * 2, 60) == brute(
        corpus(1) + EDGES + [(3, "the same row twice, long enough to be found again " * 2)] * 2, 60)


def test_runs_across_boundaries(spark):
    """One passage in every text: blocks of three suffixes, so most equal windows lie in other blocks."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = []
    for i in range(60):
        tail = "".join(r.choice("xyz") for _ in range(r.randint(0, 300)))
        a, b = sorted((r.randint(0, 300), r.randint(401, 700)))
        rows.append((i, tail[:100] + passage[a:b] + tail[100:]))
    assert answers(spark, rows, 400, block=3) == answers(spark, rows, 400) == brute(rows, 400)


def test_production_length(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert answers(spark, docs, 400) == brute(docs, 400)
    assert answers(spark, [], 400) == []


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (200, 6)).astype(np.uint64)
    got = [tuple(k) for k in keys[S.multikey_quicksort(keys)].tolist()]
    assert got == sorted(tuple(k) for k in keys.tolist())
    assert S.multikey_quicksort(keys[:1]).tolist() == [0]


def test_query_gives_what_is_left(spark, tmp_path):
    """The query's text and spans show the removal; its digest columns are those of the bytes left."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(420))
    # é and è share their first byte, é and ɩ their second: cuts fall inside characters, and in 2 the halves left meet
    rows = [(1, "one é" + passage + " end of one"), (2, "two ɩ" + passage + "éa"), (3, "three" + passage[:399] + "#"), (4, passage + "èb"),
            (5, None), (6, ""), (None, "no id"), (7, "x" * 401), (8, "alone " + "y" * 10)]
    spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in S.op3_substring_dedup(spark, str(tmp_path)).collect()}
    digests = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(g[c] for c in digests) for g in got.values()), key=str) == brute(rows, 400)
    assert {i: g.text for i, g in got.items()} == {1: "one � end of one", 2: "two ɩa", 3: rows[2][1], 4: "�b",
                                                   5: "", 6: "", None: "no id", 7: "", 8: "alone " + "y" * 10}
    for i, text in rows:
        raw = bytearray((text or "").encode())
        for a, b in reversed(got[i].spans):
            del raw[a:b]
        assert hashlib.sha256(raw).hexdigest() == got[i].kept_sha256
        assert sum(b - a for a, b in got[i].spans) == got[i].n_removed and len(got[i].spans) == got[i].n_spans
