"""Operator 12 against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest

from jobloom.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    """The root, and each node's steps: (place in its run, siblings)."""
    steps, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 2] for i in range(0, len(nodes), 2)]
        for leaf_no, p in enumerate(place):
            run = runs[p // 2]
            steps[leaf_no].append((p % 2, run[:p % 2] + run[p % 2 + 1:]))
            place[leaf_no] = p // 2
        nodes = [h(*run) for run in runs]
    return (nodes[0] if nodes else None), steps


def brute(rows):
    by_lang = {}
    for doc, text, lang, source, n in rows:
        forged = None
        if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
            forged = leaf(doc, source, lang, n + 1, text)
        by_lang.setdefault(lang, []).append((doc, leaf(doc, source, lang, n, text), forged))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        members = sorted(by_lang[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((members, *tree([x[1] for x in members])))
    root, upper = tree([t[1] for t in trees])
    out = []
    for (members, sub, steps), more in zip(trees, upper):
        for (doc, own, forged), mine in zip(members, steps):
            folded = forged or own
            for at, others in mine + more:
                folded = h(*others[:at], folded, *others[at:])
            proof = h(*(s for _, others in mine + more for s in others))
            out.append((doc, own, sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(seed, n, langs=("de", "en", None, "", "Z", "é\U0001F600")):
    r = random.Random(seed)
    return [(i * 3, r.choice([None, "", "text " * r.randrange(5), "ü\U0001F600"]), r.choice(langs), r.choice([None, "src", ""]),
             r.choice([None, 0, 12, 9223372036854775807])) for i in range(n)]


def answers(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in M.manifest(df.repartition(3), **more).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 65])
def test_equals_plain_tree(spark, n):
    rows = rows_of(n, n)
    assert answers(spark, rows) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_several_rounds(spark, levels):
    # blocks of two or four leaves: several rounds up and down, in the languages' trees and in that above them
    rows = rows_of(3, 75) + [(1000 + i, "x", f"l{i:02d}", "s", i) for i in range(9)]
    assert answers(spark, rows, levels=levels) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "a", "en", "s", 1)] * 3 + [(5, "b", "en", "s", 1), (None, "a", "en", "s", 1), (None, None, None, None, None), (-7, "long " * 100_000, "en", "s", 3)]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, []) == []


def test_sweeps():
    leaves = [h(str(i)) for i in range(11)]
    root, steps = tree(leaves)
    found = M.rise(leaves, None)
    assert found[max(found)] == root
    for own, mine, want in zip(leaves, M.descend(found, None), steps):
        assert M.siblings(mine) == [s for _, others in want for s in others]
        assert M.fold(own, mine) == root and M.fold(h("other"), mine) != root
        assert M._unpacked(M._packed(mine)) == mine
