"""Streams give the batch answer, whatever the arrival order, replays included."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from jobloom.schemas import EVENT_SCHEMA, PROFILE_SCHEMA
from jobloom.session import fresh_path
from jobloom.sources import readers
from jobloom.sources.writers import run_id
from jobloom.streaming import logs, postings, profiles

START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    kinds = ["checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted",
             "invoice.payment_failed", "customer.created"]
    rows = [(f"e{i:03d}", START + dt.timedelta(minutes=rng.randrange(500)), rng.choice(kinds),
             rng.choice(["subscription", "payment"]), rng.choice(["c1", "c1", "c1", "c2", "c3", "c4", "", None]),
             rng.choice(["active", "past_due"]), rng.choice([0, 1700000000])) for i in range(200)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([("c1", "u1"), ("c2", "u2"), ("c3", ""), ("c4", "u1")], "customer string, user_id string")


def profile_table(spark):
    table = fresh_path(spark, "test-profiles")
    rows = [(u, "free", None, None, None) for u in ("u1", "u2", "u9")]
    spark.createDataFrame(rows, PROFILE_SCHEMA).write.parquet(f"{table}/base")
    return table


def expected(events, customers):
    user = {r.customer: r.user_id for r in customers.collect() if r.user_id}
    state = {}
    for e in sorted(events.collect(), key=lambda e: (e.ts, e.event_id)):
        status, end = None, None
        if e.type == "checkout.session.completed" and e.mode == "subscription" and e.customer:
            status = "active"
        elif e.type == "customer.subscription.updated":
            status, end = ("active" if e.status == "active" else "cancelled"), e.current_period_end or None
        elif e.type == "customer.subscription.deleted":
            status = "cancelled"
        elif e.type == "invoice.payment_failed" and e.customer:
            status = "past_due"
        if status and user.get(e.customer):
            state[user[e.customer]] = (status, e.customer, end, e.ts)
    return state


def states(df):
    rows = df.select("id", "subscription_status", "stripe_customer_id", F.unix_timestamp("subscription_end"), "updated_at")
    return {r[0]: tuple(r)[1:] for r in rows.collect()}


def test_batch_fold(events, customers):
    got = profiles.latest_per_user(events, customers).select(
        F.col("user_id").alias("id"), "subscription_status", F.col("customer").alias("stripe_customer_id"),
        "subscription_end", F.col("ts").alias("updated_at"))
    assert states(got) == expected(events, customers)


def test_stream_fold_survives_disorder_and_replay(spark, events, customers):
    table, landing = profile_table(spark), fresh_path(spark, "test-events")
    pieces = events.orderBy(F.rand(7)).repartition(6)
    pieces.write.json(landing)
    want = expected(events, customers)
    for checkpoint in ("one", "two"):  # a new checkpoint delivers every event again
        stream = readers.read_events(spark, landing)
        profiles.fold_profiles(stream, customers, table, f"{table}/cp-{checkpoint}").awaitTermination()
        got = states(profiles.current_profiles(spark, table))
        assert {k: v for k, v in got.items() if v[0] != "free"} == want
        assert set(got) == {"u1", "u2", "u9"} and got["u9"][0] == "free"


def test_late_event_does_not_overwrite(spark, customers):
    table = profile_table(spark)
    row = lambda i, minute, kind: (i, START + dt.timedelta(minutes=minute), kind, "subscription", "c1", "", 0)
    newer = spark.createDataFrame([row("b", 10, "customer.subscription.deleted")], EVENT_SCHEMA)
    late = spark.createDataFrame([row("a", 5, "checkout.session.completed")], EVENT_SCHEMA)
    profiles.upsert_profiles(profiles.effective_events(newer), table, 0, customers)
    profiles.upsert_profiles(profiles.effective_events(late), table, 1, customers)
    assert states(profiles.current_profiles(spark, table))["u1"][0] == "cancelled"
    compacted = fresh_path(spark, "test-compacted")
    profiles.compact_profiles(spark, table, compacted)
    profiles.upsert_profiles(profiles.effective_events(late), compacted, 2, customers)
    assert states(profiles.current_profiles(spark, compacted)) == states(profiles.current_profiles(spark, table))
    assert spark.read.parquet(f"{compacted}/changes").where("batch = -1").count() == 1


def test_messages_and_dedup(spark, events):
    messages = events.select(F.to_json(F.struct(*events.columns)).cast("binary").alias("value"))
    assert readers.parse_events(messages).count() == 200
    out = fresh_path(spark, "test-dedup")
    landing = fresh_path(spark, "test-twice")
    events.unionAll(events).repartition(3).write.json(landing)
    stream = profiles.dedup_events(readers.read_events(spark, landing))
    (stream.writeStream.option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).format("parquet")
     .option("path", f"{out}/rows").start().awaitTermination())
    got = spark.read.parquet(f"{out}/rows")
    assert got.count() == got.select("event_id").distinct().count() == 200


def test_ingest_adds_only_new_ids_and_restarts(spark):
    landing, table = fresh_path(spark, "test-cards"), fresh_path(spark, "test-table")
    schema = "job_id string, n int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    run = lambda: postings.ingest_new_postings(
        spark.readStream.schema(schema).parquet(landing), f"{table}/rows", f"{table}/cp", "job_id", ["n"]).awaitTermination()
    write([("a", 1), ("a", 0), ("b", 2), ("", 3)])
    run()
    write([("b", 9), ("c", 4)])
    run()
    run()
    rows = {(r.job_id, r.n) for r in spark.read.parquet(f"{table}/rows").collect()}
    assert rows == {("a", 0), ("b", 2), ("c", 4)}
    # the same batch again: it replaces its own rows and sees only earlier ones
    again = spark.createDataFrame([("b", 9), ("c", 4)], schema)
    postings.add_new(again, f"{table}/rows", run_id(spark, f"{table}/cp"), 1, "job_id", ["n"])
    assert {(r.job_id, r.n) for r in spark.read.parquet(f"{table}/rows").collect()} == rows
    # a new checkpoint sees the rows of the old one and leaves them
    write([("a", 7), ("d", 5)])
    postings.ingest_new_postings(spark.readStream.schema(schema).parquet(landing), f"{table}/rows", f"{table}/cp-2", "job_id",
                                 ["n"]).awaitTermination()
    assert {(r.job_id, r.n) for r in spark.read.parquet(f"{table}/rows").collect()} == rows | {("d", 5)}


def test_customers_of_each_batch(spark, customers):
    table = profile_table(spark)
    known = [customers.limit(0)]
    row = (("b", START, "customer.subscription.deleted", "subscription", "c1", "", 0))
    for n in range(2):
        profiles.upsert_profiles(profiles.effective_events(spark.createDataFrame([row], EVENT_SCHEMA)), table, n, lambda: known[0])
        known[0] = customers
    assert states(profiles.current_profiles(spark, table))["u1"][0] == "cancelled"


def test_logs_stay_short_and_answers_equal_the_unmerged_ones(spark, events, customers):
    """Fourteen batches, three spans a level; every fourth batch runs twice."""
    table, plain = profile_table(spark), profile_table(spark)
    rows = fresh_path(spark, "test-rows")
    whole = events.withColumn("n", F.row_number().over(Window.orderBy(F.rand(3)))).cache()
    for n in range(14):
        part = whole.where(F.col("n") % 14 == n)
        for _ in range(2 if n % 4 == 3 else 1):
            profiles.upsert_profiles(profiles.effective_events(part), table, n, customers, fan_in=3)
            cards = part.select(F.concat_ws("-", "customer", "type").alias("job_id"), "n")
            postings.add_new(cards, rows, "r", n, "job_id", ["n"], fan_in=3)
        for log in (f"{table}/changes", f"{rows}-keys"):
            found = logs.spans(spark, log)
            assert len(found) <= 3 * 3 and len(logs._listed(spark, log)) <= 3 * 6
            assert sorted(b for s in found for b in range(s.first, s.last + 1)) == list(range(n + 1))
    profiles.upsert_profiles(profiles.effective_events(whole), plain, 0, customers)
    assert states(profiles.current_profiles(spark, table)) == states(profiles.current_profiles(spark, plain))
    got = [r.job_id for r in spark.read.parquet(rows).select("job_id").collect()]
    want = {r[0] for r in whole.select(F.concat_ws("-", "customer", "type")).collect()} - {""}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_merge_that_stops_leaves_the_log_whole(spark):
    table = fresh_path(spark, "test-stopped")
    add = lambda n: postings.add_new(spark.createDataFrame([(f"k{n}", n), ("k", n)], "job_id string, n int"), table, "r", n,
                                     "job_id", ["n"], fan_in=3)
    for n in range(3):
        add(n)
    log = postings.keys_of(table)

    def broken(keys, path):
        keys.write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError):
        logs.merge_closed(spark, log, "r", 3, lambda some: postings._read_keys(spark, log, some, "job_id"), broken, 3)
    assert [s.level for s in logs.spans(spark, log)] == [0, 0, 0]
    add(3)  # merges the three; they stay until the next merge
    assert [(s.first, s.last, s.level) for s in logs.spans(spark, log)] == [(0, 2, 1), (3, 3, 0)]
    assert len(logs._listed(spark, log)) == 5
    assert sorted(r.job_id for r in spark.read.parquet(table).collect()) == ["k", "k0", "k1", "k2", "k3"]
