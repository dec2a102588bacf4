"""Per-key operators when a key spans many slices: same answers as plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.functions import labels as L
from jobloom.operators import keyed, labels, quality

SIZE = 3


@pytest.fixture(scope="module")
def turns(spark):
    """One key owns most rows; positions have gaps."""
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 60), ("a", 4), ("b", 1), ("c", 7)):
        for pos in sorted(rng.sample(range(n * 2), n)):
            rows.append((key, pos, rng.choice(["duty", "share", "x"]), f"v{pos}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id string, ord int, kind string, value string")
    by_key = {}
    for r in sorted(rows):
        by_key.setdefault(r[0], []).append(r[1:])
    return df, by_key


def test_first_and_last_match(turns):
    df, by_key = turns
    first = keyed.with_first_match(df, ["page_id"], "ord", F.col("kind") == "duty", "m", SIZE)
    last = labels.attach_followers(df, "page_id", F.col("kind") == "duty", size=SIZE)
    for r in first.collect():
        assert r.m == min([o for o, k, _ in by_key[r.page_id] if k == "duty"], default=None)
    rows = last.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.owner == max([o for o, k, _ in by_key[r.page_id] if k == "duty" and o <= r.ord], default=None)


def test_take_while(turns):
    df, by_key = turns
    got = {(r.page_id, r.ord) for r in labels.take_while(df, "page_id", F.col("kind") == "share", size=SIZE).collect()}
    want = set()
    for key, rows in by_key.items():
        for o, k, _ in rows:
            if k == "share":
                break
            want.add((key, o))
    assert got == want


def whole(df, key, text):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r["part"] if "part" in r else 0)):
        out[r[key]] = out.get(r[key], []) + [r[text]]
    return out


def test_join_duties_over_parts(turns):
    df, by_key = turns
    long = df.withColumn("label", F.expr("case kind when 'duty' then 'Duties/Responsibilities:' "
                                         "when 'share' then 'Percentage of time' else 'Other' end"))
    got = {k: "".join(v) for k, v in whole(labels.join_duties(long, "page_id", size=SIZE), "page_id",
                                           "duties_responsibilities").items()}
    want = {}
    for key, rows in by_key.items():
        duties = []
        for _, kind, value in rows:
            if kind == "duty":
                duties.append(value)
            elif kind == "share" and duties:
                duties[-1] += f"  [{value}% of time]"
        if duties:
            want[key] = " | ".join(duties)
    assert got == want
    assert whole(labels.join_duties(long, "page_id", size=SIZE, by_part=True), "page_id", "duties_responsibilities").keys() == want.keys()


def test_sparse_positions_and_null_keys(spark):
    rows = [(None, 9_999, "Duties/Responsibilities", "A"), (None, 10_000, "Percentage of time", "40"), (None, 2_026_010_000, "Duties/Responsibilities", "B"),
            (1, 10_001, "Duties/Responsibilities", "C")]
    long = spark.createDataFrame(rows, "page_id long, ord long, label string, value string")
    got = {r.page_id: r.duties_responsibilities for r in labels.join_duties(long, "page_id").collect()}
    assert got == {None: "A  [40% of time] | B", 1: "C"}
    assert labels.take_while(long, "page_id", F.col("value") == "nothing").count() == 4
    assert labels.take_while(long, "page_id", F.col("value") == "40").count() == 2
    assert sorted(r.owner for r in labels.attach_followers(long, "page_id", F.col("value").isin("A", "C")).collect()) == [9_999, 9_999, 9_999, 10_001]
    blocks = spark.createDataFrame([(None, 20260000, "h2", "One"), (None, 20260100, "p", "x"), (None, 20290000, "p", "y")],
                                   "page_id long, ord long, tag string, text string")
    assert [tuple(r) for r in labels.segment_by_heading(blocks).collect()] == [(None, 20260000, "One", "x y")]


def test_packing_and_pivots(turns):
    df, by_key = turns
    long = df.select("page_id", "ord", F.col("kind").alias("label"), "value",
                     F.when(F.col("kind") != "x", F.col("kind")).alias("field"))
    packed = whole(labels.pack_extra(long, "page_id", size=SIZE), "page_id", "extra_sections")
    assert {k: " || ".join(v) for k, v in packed.items()} == {
        k: " || ".join(f"[x] {v}" for _, kind, v in rows if kind == "x")
        for k, rows in by_key.items() if any(kind == "x" for _, kind, _ in rows)}
    for policy, pick in (("first", 0), ("last", -1)):
        for r in labels.pivot_labels(long, "page_id", ["duty", "share"], policy).collect():
            for f in ("duty", "share"):
                assert r[f] == ([v for _, k, v in by_key[r.page_id] if k == f] or [""])[pick]
    parts = labels.pivot_labels(long, "page_id", ["duty", "share"], "append", size=SIZE)
    for f in ("duty", "share"):
        joined = {k: " ".join(x for x in v if x) for k, v in whole(parts, "page_id", f).items()}
        assert {k: v for k, v in joined.items() if v} == {
            k: " ".join(v for _, kind, v in rows if kind == f)
            for k, rows in by_key.items() if any(kind == f for _, kind, _ in rows)}
    assert parts.count() == len([k for k, rows in by_key.items() if any(kind != "x" for _, kind, _ in rows)])
    apart = labels.pivot_labels(long, "page_id", ["duty", "share"], "append", size=SIZE, by_part=True)
    assert max(r["n"] for r in apart.groupBy("page_id").agg(F.count("*").alias("n")).collect()) > 10


def test_duty_example(spark):
    rows = [(1, 0, "Percentage of time", "9"), (1, 1, "Duties/Responsibilities", "A"), (1, 2, "Percentage of time", "40"),
            (1, 3, "Duties/Responsibilities", "B"), (1, 4, "Percentage of time", "60")]
    long = spark.createDataFrame(rows, "page_id long, ord int, label string, value string")
    assert labels.join_duties(long, "page_id").first()["duties_responsibilities"] == "A  [40% of time] | B  [60% of time]"


def test_listing_gate(spark):
    good = ["Cook of soups", "Dean of arts", "Tutor in law", "Nurse for night"]
    cases = {"same": ["One two three"] * 3 + good[:1], "good": good, "unit": good + ["Perimeter College"],
             "short": ["Go home", "Next", "Dean of law"], "half": ["Go home", "Dean of law"]}
    rows = [(k, t) for k, titles in cases.items() for t in titles]
    listings = spark.createDataFrame([(k,) for k in [*cases, "empty"]], "listing string")
    out = quality.listing_looks_valid(spark.createDataFrame(rows, "listing string, title string"), "listing", "title", listings)
    assert {r.listing: r.valid for r in out.collect()} == {
        "same": False, "good": True, "unit": False, "short": False, "half": True, "empty": False}


def test_boilerplate_and_exact(spark):
    long = spark.createDataFrame([(1, 0, "USG Core Values", "x"), (1, 1, "Notes", ""), (1, 2, "Duties :", "y")],
                                 "page_id long, ord int, label string, value string")
    kept = labels.resolve_label_exact(labels.drop_boilerplate_sections(long), L.HEADING_LABELS).collect()
    assert [(r.ord, r.field) for r in kept] == [(2, "responsibilities")]


def test_segments_over_parts(spark):
    tags = [("p", "intro"), ("h2", "One"), *[("p", f"w{i}") for i in range(11)], ("h3", "Empty"), ("b", "Two:"),
            ("", "x"), ("b", "not a heading"), ("li", "y")]
    blocks = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(tags)] + [(2, 0, "p", "only")],
                                   "page_id long, ord int, tag string, text string").repartition(3)
    assert len(labels.segment_by_heading(blocks, size=SIZE).collect()) == 4
    rows = labels.segment_by_heading(blocks, size=SIZE, by_part=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.section, r.part)):
        got.setdefault((r.page_id, r.heading), []).append(r.content)
    assert {k: " ".join(v) for k, v in got.items()} == {
        (1, ""): "intro", (1, "One"): " ".join(f"w{i}" for i in range(11)), (1, "Two"): "x not a heading y",
        (2, ""): "only"}
    assert len(got[(1, "One")]) > 3


def test_each_distinct_label_is_resolved_once(spark):
    names = [None, "", *L.TABLE_LABELS, *L.SECTION_LABELS, "Salary:", "About the job", "No such label", "Closing Date "]
    long = spark.createDataFrame([(i % 3, i, n, "old") for i, n in enumerate(names * 20)], "k int, ord int, label string, field string")
    seen = []

    def counted(resolve):
        def run(table):
            seen.append(table.count())
            return resolve(table)
        return run

    for resolve in (lambda t: labels.resolve_label_rules(t, L.TABLE_LABELS, L.TABLE_RULES),
                    lambda t: labels.resolve_label_exact(t, L.TABLE_LABELS),
                    lambda t: labels.classify_label_keywords(t, L.TABLE_GROUPS)):
        want = sorted(map(tuple, resolve(long).select("k", "ord", "label", "field").collect()), key=str)
        for size in (16 << 20, 100):
            got = labels.resolve_once_per_label(long, counted(resolve), size).select("k", "ord", "label", "field")
            assert sorted(map(tuple, got.collect()), key=str) == want
    assert seen == [len(set(names)), long.count()] * 3
    plan = labels.resolve_once_per_label(long, resolve)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert labels.resolve_once_per_label(long.limit(0), resolve).count() == 0
