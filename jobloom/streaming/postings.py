"""Incremental mode as a stream: only ids not stored yet are added.

Beside the table lies the log of its keys: one folder per batch, merged in levels (`logs`). Merged keys are dealt to
`KEY_BUCKETS` folders by hash and sorted, and a batch reads the folders that its own keys fall into and no
rows, so small batches stay cheap however large the table is and however many batches came before. One stream
at a time writes a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import union_all
from ..operators.merge import dedup_listing, new_only
from ..sources.writers import checkpointed_append, run_id
from .logs import FAN_IN, Span, merge_closed, spans

KEY_BUCKETS = 64


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def keys_of(table: str) -> str:
    return f"{table.rstrip('/')}-keys"


def _read_keys(spark: SparkSession, log: str, of: list[Span], key: str, buckets: list[int] | None = None) -> DataFrame:
    """The keys of some spans of a log; of merged ones only those in `buckets`, if given."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    new, merged = [s.path for s in of if not s.level], [s.path for s in of if s.level]
    parts = [spark.read.schema(schema).parquet(*new)] if new else []
    if merged:
        folders = [T.StructField("run", T.StringType()), T.StructField("merged", T.StringType()),
                   T.StructField("_bucket", T.IntegerType())]
        dealt = spark.read.schema(T.StructType([*schema, *folders])).option("basePath", log).parquet(*merged)
        parts.append((dealt if buckets is None else dealt.where(F.col("_bucket").isin(buckets))).select(key))
    return union_all(parts) if parts else spark.createDataFrame([], schema)


def stored_keys(cards: DataFrame, table: str, key: str, run: str, batch_id: int) -> DataFrame:
    """Keys stored by other runs and by earlier batches of this one, as far as `cards` may meet them: a batch that
    runs again does not see its own."""
    spark = cards.sparkSession
    log = keys_of(table)
    earlier = [s for s in spans(spark, log) if s.run != run or s.last < batch_id]
    buckets = None
    if any(s.level for s in earlier):  # at most KEY_BUCKETS numbers
        buckets = [r[0] for r in cards.select(_bucket(key)).distinct().collect()]
    return _read_keys(spark, log, earlier, key, buckets)


def merge_keys(spark: SparkSession, table: str, key: str, run: str, before: int, fan_in: int = FAN_IN) -> int:
    """Merge the keys of closed batches of a run; returns the number of merges."""
    def write(keys: DataFrame, path: str) -> None:
        dealt = keys.withColumn("_bucket", _bucket(key))
        dealt.repartitionByRange("_bucket", key).sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(path)

    log = keys_of(table)
    return merge_closed(spark, log, run, before, lambda some: _read_keys(spark, log, some, key), write, fan_in)


def add_new(batch: DataFrame, table: str, run: str, batch_id: int, key: str, order: list[str], fan_in: int = FAN_IN) -> None:
    spark = batch.sparkSession
    merge_keys(spark, table, key, run, batch_id, fan_in)
    cards = dedup_listing(batch, key, order)
    fresh = new_only(cards, stored_keys(cards, table, key, run, batch_id), [key])
    checkpointed_append(fresh, table, str(batch_id), run)
    written = spark.read.schema(batch.schema).parquet(f"{table}/run={run}/batch={batch_id}")
    checkpointed_append(written.select(F.col(key).cast("string").alias(key)), keys_of(table), str(batch_id), run)


def ingest_new_postings(postings: DataFrame, table: str, checkpoint: str, key: str, order: list[str],
                        trigger: dict | None = None) -> StreamingQuery:
    run = run_id(postings.sparkSession, checkpoint)
    return (postings.writeStream
            .foreachBatch(lambda batch, n: add_new(batch, table, run, n, key, order))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start())
