"""Sources and sinks on small files."""

import json

from pyspark.sql import functions as F

from jobloom.operators import mapping, merge
from jobloom.schemas import CARD_COLUMNS, MASTER_COLUMNS, S1_COLUMNS, SITE_SCHEMA, SOURCES
from jobloom.session import fresh_path
from jobloom.sources import readers, writers


def test_csv_files_with_other_column_orders(spark):
    path = fresh_path(spark, "csv-orders")
    rows = spark.createDataFrame([("T1", "a"), ("T2", "b")], "job_id string, job_title string")
    rows.where("job_id = 'T1'").select("job_id", "job_title").coalesce(1).write.option("header", True).csv(path)
    rows.where("job_id = 'T2'").select("job_title", "job_id").coalesce(1).write.mode("append").option("header", True).csv(path)
    got = readers.read_source_csv(spark, path, ["job_id", "job_title", "salary"]).select("job_id", "job_title", "salary").collect()
    assert sorted(map(tuple, got)) == [("T1", "a", ""), ("T2", "b", "")]


def test_csv_quotes_newlines_order_and_size(spark, tmp_path):
    big = "x" * 3_000_000
    lines = ["job_title,job_id,extra", '"a ""q"" b",1,z', '"two\nlines, one cell",2,z', ",3,z", f"{big},4,z"]
    path = tmp_path / "s.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    df = readers.read_source_csv(spark, str(path), S1_COLUMNS)
    rows = df.orderBy("ord").collect()
    assert [r.job_id for r in rows] == ["1", "2", "3", "4"]
    assert [r.job_title for r in rows] == ['a "q" b', "two\nlines, one cell", "", big]
    assert rows[0].institution == "" and df.columns == ["ord", *S1_COLUMNS]


def test_order_over_many_files(spark, tmp_path):
    for name, ids in (("b.csv", range(100, 200)), ("a.csv", range(100)), ("c.csv", range(200, 205))):
        (tmp_path / name).write_text("job_id\n" + "\n".join(map(str, ids)))
    df = readers.read_source_csv(spark, str(tmp_path), S1_COLUMNS)
    assert [int(r.job_id) for r in df.orderBy("ord").collect()] == list(range(205))


def test_sources_in_registry_order(spark, tmp_path):
    (tmp_path / "s3.csv").write_text("job_id,job_title,posting_url\n9,Late,http://x\n")
    (tmp_path / "s1.csv").write_text("job_id,job_title,posting_url\n1,First,http://x\n2,,http://y\n")
    raw = readers.read_all_sources(spark, {k: str(tmp_path / f"{k}.csv") for k in SOURCES})
    assert list(raw) == ["s1", "s3"]
    rows = merge.merge_master(mapping.union_sources(raw)).collect()
    assert [(r.job_id, r.source_key) for r in rows] == [("1", "s1")]
    out = fresh_path(spark, "test-master")
    counts = writers.publish_master(merge.merge_master(mapping.union_sources(raw)), out, MASTER_COLUMNS)
    assert counts["loaded"].collect()[0].loaded == 1 and counts["by_source"].count() == 1
    assert counts["by_institution"].first().institution == "Georgia Institute of Technology"
    assert spark.read.json(f"{out}/json").first().job_title == "First"
    assert spark.read.csv(f"{out}/csv", header=True).columns == MASTER_COLUMNS


def test_documents(spark, tmp_path):
    listing = tmp_path / "listing.json"
    listing.write_text(json.dumps([{"job_id": "1", "job_title": "Köch"}, {"job_id": "2", "junk": 1}], indent=1))
    rows = readers.read_listing_json(spark, str(listing), CARD_COLUMNS).collect()
    assert [(r.job_id, r.job_title) for r in rows] == [("1", "Köch"), ("2", "")]
    site = tmp_path / "jobs.json"
    site.write_text(json.dumps({"meta": {"total": 2}, "jobs": [{"id": "1", "remote": True}, {"id": "2"}]}))
    rows = readers.read_site_document(spark, str(site), SITE_SCHEMA).collect()
    assert [(r.id, r.remote) for r in rows] == [("1", True), ("2", None)]


def test_feed(spark, tmp_path):
    entry = "<entry><id>{}</id><title>{}</title>{}</entry>"
    body = "".join([
        entry.format("tag:x,2005:/postings/7", " A &amp; B ", '<link rel="edit" href="e"/><link href="https://f/7"/><published>2026-01-02T00:00</published>'),
        entry.format("tag:x,2005:/postings/7", "again", ""),
        entry.format("tag:none", "no id", ""),
        entry.format("tag:x,2005:/postings/8", "C", "<updated>2026-02-03T00:00</updated>")])
    path = tmp_path / "feed.xml"
    path.write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    rows = readers.read_feed(spark, str(path), "https://h").orderBy("posting_id").collect()
    assert [(r.posting_id, r.posting_url, r.working_title, r.published) for r in rows] == [
        ("7", "https://f/7", "A & B", "2026-01-02"), ("8", "https://h/postings/8", "C", "2026-02-03")]


def test_snapshot(spark):
    path = fresh_path(spark, "test-snapshot")
    schema = spark.createDataFrame([], "ord int, job_id string").schema
    load = lambda **kw: readers.load_existing(spark, path, schema, "job_id", **kw)
    assert load().count() == 0
    spark.createDataFrame([(1, "a"), (2, " a "), (3, ""), (4, "b")], schema).write.parquet(path)
    assert sorted(r.ord for r in load().collect()) == [2, 4]
    assert load(full_refresh=True).count() == 0


def test_resume(spark):
    path = fresh_path(spark, "test-resume")
    for n in (0, 1, 1):
        writers.checkpointed_append(spark.range(n * 50, n * 50 + 50), path, str(n))
    assert spark.read.parquet(path).select(F.sum("id")).first()[0] == sum(range(100))
