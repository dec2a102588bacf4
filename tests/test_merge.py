"""Mapping, dedup and incremental merges against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import mapping, merge, site
from jobloom.schemas import MASTER_COLUMNS, MASTER_SCHEMA, S0_COLUMNS, S1_COLUMNS, SITE_COLUMNS, strings


def raw(spark, columns, rows):
    df = spark.createDataFrame([(i, *[r.get(c) for c in columns]) for i, r in enumerate(rows)],
                               "ord int, " + ", ".join(f"{c} string" for c in columns))
    return mapping.conform(df, strings(columns), keep=("ord",))


def test_first_source_mapping(spark):
    df = raw(spark, S0_COLUMNS, [{
        "posting_number": " S1 ", "working_title": "Cook", "special_instructions": "x  y", "physical_demands": "",
        "fte": " 1.0", "flsa": "", "work_schedule": "M-F", "position_of_trust": "YES", "p_card_required": " yes",
        "regular": "r"}])
    row = mapping.to_master(df, "s0").first().asDict()
    assert row["job_id"] == "S1" and row["institution"] == "University of Georgia"
    assert row["other_information"] == "x y | FTE:  1.0 | Work schedule: M-F"
    assert row["background_check"] == "Position of Trust"
    assert row["extra_sections"] == row["regular_temporary"] == "" and row["source"] == "UGA (PeopleAdmin)"
    assert [c for c in row if c != "ord"] == MASTER_COLUMNS


@pytest.mark.parametrize("key, given, want", [
    ("s1", "", "Georgia Institute of Technology"), ("s1", "Other", "Other"), ("s2", "", ""),
    ("s2", "Any", "Any"), ("s3", "Any", "Georgia State University")])
def test_institution_rules(spark, key, given, want):
    df = raw(spark, S1_COLUMNS, [{"institution": given, "close_date": "x"}])
    row = mapping.to_master(df, key).first()
    assert row["institution"] == want and row["close_date"] == ""


def test_conform(spark):
    df = spark.createDataFrame([("a", None, 3)], "job_id string, source string, extra int")
    out = mapping.conform(df, MASTER_SCHEMA)
    assert out.columns == MASTER_COLUMNS and out.first()["source"] == "" and out.first()["job_title"] == ""


def python_merge(rows):
    seen, out = set(), []
    for rank, pos, title, url, job_id in sorted(rows):
        key = url or job_id
        if not title or (key and key in seen):
            continue
        seen.add(key)
        out.append((rank, pos))
    return sorted(out)


def test_dedup_matches_python_with_hot_and_blank_keys(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, rng.choice(["t", "t", ""]), rng.choice(["", "", "hot", "hot", f"u{rng.randrange(9)}", "j3"]),
             rng.choice(["", f"j{rng.randrange(9)}", "hot"])) for i in range(600)]
    df = spark.createDataFrame(rows, "source_rank int, ord int, job_title string, posting_url string, job_id string")
    once = merge.merge_master(df.repartition(5))
    got = sorted((r.source_rank, r.ord) for r in once.collect())
    assert got == python_merge(rows)
    again = merge.merge_master(once)
    assert sorted((r.source_rank, r.ord) for r in again.collect()) == got


def postings(rng, n, version):
    return [(i, rng.choice(["", f"n{rng.randrange(20)}"]), rng.choice(["", " ", f"u{rng.randrange(20)}"]), version)
            for i in range(n)]


SCHEMA = "ord int, number string, url string, version string"


def keyed(rows):
    """Both keys of every stored row; the last row of a key wins."""
    out = {}
    for r in rows:
        for key in (r[1].strip(), r[2].strip()):
            if key:
                out[key] = r
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_incremental_merges_match_python(spark, seed):
    rng = random.Random(seed)
    old, new = postings(rng, 40, "old"), postings(rng, 60, "new")
    old_df, new_df = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)

    stored = keyed(old)
    fresh = [r[0] for r in new if r[1].strip() not in stored and r[2].strip() not in stored]
    got = merge.new_only(new_df, old_df, ["number", "url"]).select("ord").collect()
    assert sorted(r.ord for r in got) == fresh

    numbers = {r[1].strip() for r in old} - {""}
    single = merge.new_only(new_df, old_df, ["number"])
    assert sorted(r.ord for r in single.collect()) == [r[0] for r in new if r[1].strip() not in numbers]
    both = merge.append_new(old_df, new_df, key="number")
    assert both.count() == len(old) + single.count()

    merged = {}
    for r in old + new:
        if r[2].strip():
            merged[r[2].strip()] = r
    got = merge.upsert_newest(old_df, new_df, key="url").select("ord", "version").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[3]) for r in merged.values())

    canon = lambda r: r[1].strip() or r[2].strip()
    latest_new = {canon(r): r for r in new if canon(r)}
    latest_old = {}
    for r in stored.values():
        latest_old.setdefault(canon(r), r)
    want = [(r[0], "new", False) for r in latest_new.values()]
    want += [(r[0], "old", True) for k, r in latest_old.items() if k not in latest_new]
    flat = merge.dedup_dual_keyed(old_df, "number", "url")
    assert sorted(r.ord for r in flat.collect()) == sorted(r[0] for r in latest_old.values())
    got = merge.upsert_canonical(old_df, new_df, "number", "url").select("ord", "version", "carried").collect()
    assert sorted(map(tuple, got)) == sorted(want)

    unique = merge.dedup_dual_keyed(old_df, "number", "url")
    by_anti = merge.upsert_canonical(unique, new_df, "number", "url", stored_unique=True)
    assert sorted(map(tuple, by_anti.select("ord", "version", "carried").collect())) == sorted(want)
    by_url = merge.load_keyed(old_df, "url", "ord")
    by_anti = merge.upsert_newest(by_url, new_df, key="url", stored_unique=True).select("ord", "version").collect()
    assert sorted(map(tuple, by_anti)) == sorted((r[0], r[3]) for r in merged.values())

    stats = merge.merge_accounting(old_df, new_df, key="url").first()
    a, b = ({r[2].strip() for r in rows} - {""} for rows in (old, new))
    assert tuple(stats) == (len(b), len(b - a), len(a & b), len(a - b), len(a | b))


def test_enrich_policies_and_stubs(spark):
    cards = spark.createDataFrame([("1", "card t", "card d", "u1"), ("2", "", "", "u2"), ("3", "x", "y", "u3")],
                                  "job_id string, job_title string, department string, url string")
    details = spark.createDataFrame([("1", "detail t", "detail d", "a1"), ("2", "t2", "d2", "")],
                                    "job_id string, job_title string, department string, apply_link string")
    out = merge.enrich_listing(cards, details, "job_id", {"department": "card"}, url="url")
    rows = {r.job_id: r for r in out.collect()}
    assert (rows["1"].job_title, rows["1"].department, rows["1"].apply_link) == ("detail t", "card d", "a1")
    assert (rows["2"].job_title, rows["2"].department, rows["2"].apply_link) == ("t2", "d2", "u2")
    assert rows["3"].stub and rows["3"].apply_link == rows["3"].posting_url == "u3" and rows["3"].job_title == "x"
    assert [r.job_id for r in merge.stub_missing(cards, details, "job_id", "url").collect()] == ["3"]


def test_site_rows(spark):
    rows = [
        {"job_id": "1", "job_title": " A  B ", "salary": "", "extra_sections": "[Pay Range] $20 per hour", "source": "x",
         "apply_link": "?a", "posting_url": "http://p", "posted_date": "03/06/26", "job_summary": "s",
         "responsibilities": "r", "location": "Remote", "full_part_time": "part", "regular_temporary": "perm"},
        {"job_id": " ", "job_title": "dropped"},
        {"job_id": "3", "department": "Return to the home page Job Type: Full-Time Salary: $1,000 - $2,000",
         "source": "Georgia State University", "job_summary": "x " * 500},
    ]
    df = spark.createDataFrame([tuple(r.get(c, "") for c in MASTER_COLUMNS) for r in rows], MASTER_SCHEMA)
    out = {r.id: r.asDict() for r in site.to_site(df).collect()}
    assert set(out) == {"1", "3"} and list(out["1"]) == SITE_COLUMNS
    first = out["1"]
    assert first["title"] == "A B" and first["salary"] == "$20 per hour" and first["salary_type"] == "Hourly"
    assert first["apply"] == first["view"] == "http://p" and first["posted"] == "2026-03-06" and first["summary"] == "s r"
    assert first["remote"] is True and first["type"] == "Part-Time" and first["employment"] == "Regular"
    third = out["3"]
    assert third["department"] == "" and third["salary"] == "$1,000 - $2,000" and third["type"] == "Full-Time"
    assert third["salary_type"] == "Annual" and third["summary"] == ("x " * 350).strip() + "…"


def test_facets_break_ties_by_first_appearance(spark):
    rows = [(0, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "b", ""), (3, "a", ""), (4, "", "2024-01-03"),
            (5, "c", "2024-01-02"), (6, "c", "")]
    df = spark.createDataFrame(rows, "ord int, institution string, posted string").withColumn("location", F.col("institution"))
    # newest first: 4(''), 1(b), 5(c), 0(a), then the undated
    assert [r.value for r in site.facet_values(df, "institution").collect()] == ["b", "c", "a"]
    meta = site.site_meta(df).first()
    assert meta.total == 7 and meta.institutions == ["b", "c", "a"] and meta.locations == ["b", "c", "a"]
    assert [r.ord for r in site.newest_first(df).collect()] == [4, 1, 5, 0, 2, 3, 6]
    assert [r.institution for r in site.top_institutions(df, 2).collect()] == ["b", "c"]
    # with sources, ties follow the source before the place in it
    ranked = df.withColumn("source_rank", F.when(F.col("institution") == "b", 1).otherwise(0))
    assert [r.value for r in site.facet_values(ranked, "institution").collect()] == ["c", "b", "a"]
    assert [r.ord for r in site.newest_first(ranked).collect()] == [4, 5, 1, 0, 3, 6, 2]


def test_sorted_site_equals_site_sorted(spark):
    rows = [(i % 3, i, f"j{i}", f"2026-0{i % 4 + 1}-01" if i % 5 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "source_rank int, ord int, job_id string, posted_date string").repartition(7)
    a = [tuple(r) for r in site.newest_site(df).collect()]
    assert a == [tuple(r) for r in site.newest_first(site.to_site(df)).collect()] and len(a) == 60


def test_expire_and_dual_dedup(spark):
    df = spark.createDataFrame([(1, "n", "u"), (2, "n", "u"), (3, "", "u"), (4, "", "")], "ord int, number string, url string")
    assert sorted(r.ord for r in merge.dedup_dual_keyed(df, "number", "url").collect()) == [2, 3]
    kept = merge.expire_missing(df, df.where("ord = 1"), "number")
    assert sorted(r.ord for r in kept.collect()) == [1, 2]
