"""Physical plans hold what the design promises."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators import merge, site
from jobloom.plans import queries as Q, standins as S
from jobloom.schemas import MASTER_SCHEMA

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_prunes_before_the_shuffle(spark):
    text = plan(Q.merge_dedup(spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("query", [Q.new_only_dual, Q.upsert_canonical, Q.upsert_newest, Q.enrich_listing,
                                   Q.take_while, Q.join_duties, Q.attach_followers, Q.facet_titles, Q.profile_status,
                                   Q.postings_tables, Q.site_meta, Q.similar_top5])
def test_no_cross_or_nested_loop_join(spark, query):
    text = plan(query(spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_upserts_are_one_pruned_shuffle(spark):
    assert "WindowGroupLimit" in plan(Q.upsert_newest(spark, SF))
    assert "WindowGroupLimit" in plan(Q.upsert_canonical(spark, SF))


def test_site_is_one_compiled_stage_without_python(spark):
    df = site.to_site(spark.createDataFrame([], MASTER_SCHEMA))
    master = S.table(spark, SF, "documents").select(
        F.col("text").alias("job_summary"), F.col("doc_id").cast("string").alias("job_id"), F.col("source"))
    text = plan(site.to_site(master))
    assert "Exchange" not in text and "Python" not in text
    for line in text.splitlines():
        if "Project" in line:
            assert "*(" in line
    assert df.columns[0] == "id"


def test_pages_need_no_shuffle(spark):
    for query in (Q.page_blocks, Q.page_sections, Q.page_links, Q.page_label_values, Q.page_indexed_fields,
                  Q.listing_spans, Q.listing_cards):
        text = plan(query(spark, SF))
        assert "Exchange" not in text and "Python" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(S.table(spark, SF, "documents").select(Q.X.truncate("text")))
    assert "ReadSchema: struct<text:string>" in text
    counted = plan(Q.quality_by_source(spark, SF))
    assert counted.count("html") == 0


def test_blank_cards_are_spread(spark):
    """A third of all cards without a key must not meet in one task."""
    cards = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "").otherwise(
        F.col("id").cast("string")).alias("number"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = merge.new_only(cards, cards.where("ord < 0"), ["number"])
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and max(sizes) < 1.5 * 3000 / 4


def test_hot_card_id_is_split_by_the_adaptive_join(spark):
    """A third of the listing repeats one id: its partition is read by several tasks."""
    cards = spark.range(60_000, numPartitions=8).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("number"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = merge.new_only(cards, cards.where("ord % 7 = 1"), ["number"])
        rows = out.collect()
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "skew=true" in text
    stored = {"hot" if i % 3 == 0 else str(i) for i in range(60_000) if i % 7 == 1}
    assert len(rows) == sum(1 for i in range(60_000) if ("hot" if i % 3 == 0 else str(i)) not in stored)
