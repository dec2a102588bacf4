"""Subscription events to profile status.

The profile table is a base snapshot plus a change log with one folder per run (checkpoint)
and micro-batch. A batch that runs again replaces its own folder, and the current
state takes the latest change by (ts, event_id), so replays and late events
cannot overwrite newer ones. Closed batches are merged in levels (`logs`), one change per user left in each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.events import event_end, event_status
from ..operators.merge import attach_user
from ..schemas import PROFILE_SCHEMA
from ..sources.writers import checkpointed_append, run_id
from .logs import FAN_IN, Span, merge_closed, spans

EVENT_TIME = ["ts", "event_id"]
#: For events that carry `arrival`, a number that grows with delivery (such as the offset in their log).
ARRIVAL = ["arrival", *EVENT_TIME]
STATUS_FIELDS = ["customer", "subscription_status", "subscription_end", "ts", "event_id"]


def effective_events(events: DataFrame) -> DataFrame:
    """Events that change a status, with the new status and their `arrival` if they have one; works on streams and tables."""
    return events.select(
        "event_id", "ts", "customer", *[c for c in events.columns if c == "arrival"],
        event_status("type", "mode", "status", "customer").alias("subscription_status"),
        event_end("type", "current_period_end").alias("subscription_end"),
    ).where(F.col("subscription_status").isNotNull())


def status_stream(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Effective events with their user (stream-static inner join)."""
    return attach_user(effective_events(events), customers)


def _latest(df: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """The last event per key decides every field; combined map-side."""
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(key).agg(last.alias("e")).select(key, *[F.col("e")[f].alias(f) for f in fields if f != key])


def latest_per_user(events: DataFrame, customers: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per user: the last effective event.

    Events shrink to one per customer before the join, so a customer with most of
    the events costs no more than any other. `order` may name an arrival column.
    """
    order = order or EVENT_TIME
    fields = list(dict.fromkeys(STATUS_FIELDS + order))
    per_customer = _latest(effective_events(events) if "type" in events.columns else events,
                           "customer", fields, order)
    return _latest(attach_user(per_customer, customers), "user_id", fields, order)


# --- table ----------------------------------------------------------------------------

CHANGE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("subscription_status", T.StringType()),
    T.StructField("subscription_end", T.TimestampType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("arrival", T.LongType()),
])


def _as_changes(changes: DataFrame) -> DataFrame:
    return changes.select(*[(F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in CHANGE_SCHEMA])


def upsert_profiles(batch: DataFrame, table: str, batch_id: int, customers: DataFrame | Callable[[], DataFrame], run: str = "0",
                    order: list[str] | None = None, fan_in: int = FAN_IN) -> None:
    """Log the batch's last change per user by `order`; `customers` may be a function that reads them anew."""
    spark = batch.sparkSession
    merge_closed(spark, f"{table}/changes", run, batch_id, lambda some: _as_changes(_last_changes(_read_changes(spark, some), order)),
                 lambda changes, path: changes.write.parquet(path), fan_in)
    changes = latest_per_user(batch, customers() if callable(customers) else customers, order)
    checkpointed_append(_as_changes(changes), f"{table}/changes", str(batch_id), run)


def _read_changes(spark: SparkSession, of: list[Span]) -> DataFrame:
    return spark.read.schema(CHANGE_SCHEMA).parquet(*[s.path for s in of])


def _last_changes(changes: DataFrame, order: list[str] | None) -> DataFrame:
    order = order or EVENT_TIME
    return _latest(changes, "user_id", list(dict.fromkeys(STATUS_FIELDS + order)), order)


def current_profiles(spark: SparkSession, table: str, order: list[str] | None = None) -> DataFrame:
    """Base profiles with their latest change: updates only, never a new row. `order` is that of `fold_profiles`."""
    base = spark.read.schema(PROFILE_SCHEMA).parquet(f"{table}/base")
    log = spans(spark, f"{table}/changes")
    if not log:
        return base
    latest = _last_changes(_read_changes(spark, log), order)
    joined = base.join(latest, base["id"] == latest["user_id"], "left")
    hit = F.col("user_id").isNotNull()
    new = {"subscription_status": latest["subscription_status"], "stripe_customer_id": F.col("customer"),
           "subscription_end": latest["subscription_end"], "updated_at": F.col("ts")}
    return joined.select("id", *[F.when(hit, c).otherwise(base[name]).alias(name) for name, c in new.items()])


def compact_profiles(spark: SparkSession, table: str, target: str, order: list[str] | None = None) -> None:
    """Copy the table with one change per user left in its log, which still guards against late events."""
    current_profiles(spark, table, order).write.parquet(f"{target}/base")
    if log := spans(spark, f"{table}/changes"):
        checkpointed_append(_as_changes(_last_changes(_read_changes(spark, log), order)), f"{target}/changes", "-1")


def fold_profiles(events: DataFrame, customers: DataFrame | Callable[[], DataFrame], table: str, checkpoint: str,
                  trigger: dict | None = None, order: list[str] | None = None) -> StreamingQuery:
    """Start the stream that keeps the change log up to date.

    With a function for `customers`, each batch meets the customers of its time. By default events apply in
    event time; with `order=ARRIVAL` in the order they were delivered, whatever batch a number falls into, so a
    batch that runs again, and a number that is delivered twice, change nothing.
    """
    run = run_id(events.sparkSession, checkpoint)
    return (effective_events(events).writeStream
            .foreachBatch(lambda batch, n: upsert_profiles(batch, table, n, customers, run, order))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start())


def dedup_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Replay guard: one event per id inside the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
