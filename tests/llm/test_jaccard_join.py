import random
import re

import numpy as np

from jobloom.llm import jaccard_join as J
from jobloom.llm.components import components

SCHEMA = "doc_id long, text string, s string, n int, component_id string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if d is not None and find(k) == find(i)]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed, docs=160, vocabulary=40):
    r = random.Random(seed)
    base = [[f"w{r.randrange(vocabulary * 20)}" for _ in range(r.choice([5, 8, 30, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            words[r.randrange(len(words))] = f"x{r.randrange(30)}"
        if r.random() < 0.2:
            words = words[:r.randrange(1, len(words))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows


EDGES = [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (None, "one two"), (None, None),
         (906, "É é"), (907, "é é"), (903, "one two"), (908, "a b c d e"), (909, "a b c d e f"), (910, "long text " * 4000), (911, "Long text " * 3999)]


def answers(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in J.link_components(df.repartition(3), **more).collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus(1) + EDGES
    assert answers(spark, rows) == brute(rows)


def test_large_cluster_near_the_threshold(spark, monkeypatch):
    # one text with one or two words changed: many pairs above, many below; few neighbours, so later rounds must link
    monkeypatch.setattr(J, "NEIGHBOURS", 1)
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            words[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert answers(spark, rows, limits=(1, 2, None)) == answers(spark, rows) == brute(rows)


def test_buckets_in_blocks(spark, monkeypatch):
    # blocks are dealt on the driver's side: with 7 rows a block, every bucket is cut both ways
    monkeypatch.setattr(J, "NEIGHBOURS", 1)
    monkeypatch.setattr(J, "BLOCK", 7)
    rows = corpus(11, docs=120, vocabulary=2)
    assert answers(spark, rows, limits=(2, None)) == brute(rows)


def test_sets_that_hang_together_meet_in_one_place(spark, monkeypatch):
    # a chain whose pairs come from four buckets, and a pair elsewhere
    pairs = [(1, 2, 91, 10), (2, 3, 92, 10), (3, 4, 93, 10), (4, 5, 94, 10), (7, 8, 91, 10)]
    likely = spark.createDataFrame(pairs, "a long, b long, token long, size long")
    got = {(r.a, r.b): r.token for r in J._gathered(likely).collect()}
    assert len({got[p] for p in got if p != (7, 8)}) == 1 and got[7, 8] != got[1, 2]
    monkeypatch.setattr(J, "PLACE", 25)
    got = {(r.a, r.b): (r.token, r["size"]) for r in J._gathered(likely).collect()}
    assert all(got[a, b] == (token, size) for a, b, token, size in pairs[:4])


def test_buckets_without_more_pairs_are_done(spark, monkeypatch):
    monkeypatch.setattr(J, "NEIGHBOURS", 1)
    met, rounds = J._met, []

    def seen(rows, percent, limit):
        out = met(rows, percent, limit).cache()
        rounds.append(({r.token for r in rows.select("token").distinct().collect()}, {r.token for r in out.where("more").select("token").distinct().collect()}))
        return out

    monkeypatch.setattr(J, "_met", seen)
    r = random.Random(9)
    rows = []
    for i in range(150):
        words = [f"w{i % 5 > 0}_{j}" for j in range(80)]  # a small family and a large one
        for _ in range(r.choice([1, 1, 2, 3])):
            words[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert answers(spark, rows, limits=(2, None)) == brute(rows)
    assert len(rounds) == 2 and rounds[1][0] <= rounds[0][1] < rounds[0][0]


def test_large_sets_are_told_apart_without_their_texts(spark):
    # the narrow bitmap of a set with thousands of shingles is full and leaves every pair possible
    r = np.random.default_rng(4)
    x = np.unique(r.integers(0, 1 << 64, 6000, np.uint64))
    sets = [x, np.concatenate([x[300:], r.integers(0, 1 << 64, 3500, np.uint64)]), np.concatenate([x[200:], r.integers(0, 1 << 64, 200, np.uint64)]),
            r.integers(0, 1 << 64, 6000, np.uint64), x[:900]]
    wide = [J._wide(s) if len(s) > J.BITS else None for s in sets]
    for i in range(4):
        for j in range(4):
            assert J._odd_cells(wide[i], wide[j]) <= len(np.setxor1d(sets[i], sets[j]))
    classes = spark.createDataFrame(list(enumerate(wide)), "s long, wide binary")
    pairs = [(a, b, 7, len(sets[a]) + len(sets[b])) for a in range(5) for b in range(a)]
    likely = spark.createDataFrame(pairs, "a long, b long, token long, size long")
    got = {(r.a, r.b) for r in J._likely_large(likely, classes, 80).collect()}
    assert got == {(2, 0)} | {(4, b) for b in range(4)}
    words = [f"w{i}" for i in range(2600)]
    rows = [(i, " ".join(words[:50 * i] + [f"x{i}_{j}" for j in range(25 * i)] + words[60 * i:])) for i in range(12)]
    rows += [(20 + i, " ".join(words[k] for k in r.permutation(2600))) for i in range(3)]
    assert answers(spark, rows) == brute(rows)


def test_hot_shingles_are_dealt(spark):
    rows = corpus(5, docs=100)
    assert answers(spark, rows, crowd=8) == brute(rows)


def test_near_copy_of_many_equal_texts(spark):
    # all shared shingles are dealt to 25 parts, where the group of the copies and that of the near copy are alone
    words = [f"w{i}" for i in range(80)]
    rows = [(i + 1, " ".join(words)) for i in range(100)] + [(0, " ".join(words[:40] + ["other"] + words[41:]))]
    assert {c for _, _, c in brute(rows)} == {0}
    assert answers(spark, rows, crowd=8) == brute(rows)


def test_empty_table_and_stage(spark):
    assert answers(spark, []) == []
    rows = corpus(3, docs=40) + EDGES
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    kept = J.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    # one row of each group, with its smallest id; all rows without words
    groups = {}
    for g, s, (doc, text) in zip(group, sets, rows):
        groups.setdefault(g if s else object(), []).append((doc, text))
    assert len(got) == len(groups)
    for members in groups.values():
        ids = [d for d, _ in members if d is not None]
        assert sum((min(ids) if ids else None, t) in got for t in {t for _, t in members}) >= 1


def test_stage_keeps_unlinked_rows_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (None, a), (None, b + " more"), (2, b), (2, b), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in J.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, None), (None, None), (3, "")], key=str)


def test_components(spark):
    r = random.Random(0)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    group = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    got = {r.s: r.c for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == group
