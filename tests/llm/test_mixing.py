import random
from collections import defaultdict
from itertools import cycle

import pytest

from jobloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, size string, target int, key string"


def brute_targets(sizes):
    """Reshare by weight, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = dict(zip(names, cycle((3, 1, 2))))
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def held(rows):
    sizes, taken, target, biggest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and {r.source_size for r in rows if r.source == s} == {sizes[s]}
        assert abs(taken[s] - target[s]) <= biggest[s] / 2
    return sizes, taken, target


def test_targets_and_sample(spark):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 97)), s, "x", 1, "k") for s, n in (("a", 40), ("b", 400), ("c", 15), (None, 120), ("n", 60))
            for i in range(n)] + [(None, None, "a", None, None, None), (5, "", "empty", "", 0, ""), (None, "two words", "c", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mix(df).collect()
    assert len(got) == len(rows)
    held(got)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(2)).collect()))


def test_many_sources(spark):
    rng = random.Random(8)
    for n in (2, 13, 40):
        rows = [(i, "w " * rng.randint(1, 40), f"s{rng.randrange(n) ** 2 % n}", "", 0, "") for i in range(25 * n)]
        sizes = held(mix(spark.createDataFrame(rows, SCHEMA)).collect())[0]
        assert sum(brute_targets(sizes).values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_large_documents_are_likelier(spark):
    rows = [(i, "w " * (10 if i % 2 else 100), s, "", 0, "") for s in ("a", "b", "c") for i in range(400)]
    got = [r for r in mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "b"]
    extra = lambda n: sum(r.copies for r in got if r.size == n) / 200
    assert extra(100) > 4 * extra(10)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "same text here", "a", "", 0, "")] * 30 + [(2, "one", "b", "", 0, "")]
    held(mix(spark.createDataFrame(rows, SCHEMA)).collect())
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None, "", 0, "")], SCHEMA)).collect()] == [0]
