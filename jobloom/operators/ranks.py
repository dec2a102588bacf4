"""Stable input order and dense row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Input order of a file scan: `(file, block, position)`, compared field by field.

    Must follow the scan directly. Files are ordered by name, blocks of a split file
    by offset, rows of a block by their place in it.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos")))


def dense_index(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """Add a dense 0-based number in `order`.

    A range sort spreads the rows; the sorted rows are checkpointed so partitions
    stay put; per-partition counts (one row per partition) give each its offset.
    Pass only the columns needed, as they are all written once, and an order without
    ties, so that one value never fills a sort partition.
    """
    low = 33  # monotonically_increasing_id keeps the position in its low 33 bits
    placed = (checkpointed(df.orderBy(*order))
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_id", low)))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_id") - F.shiftleft("_pid", low)
    # one row per partition of the sort, so the number of tasks bounds the broadcast
    return (placed.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_offset") + position).drop("_id", "_pid", "_offset"))


def row_index(df: DataFrame, id_col: str, order: list) -> DataFrame:
    """`(id, row_index)`: dense job-order index; a repeated id maps to its last index."""
    names = [c for c in order if isinstance(c, str)]
    columns = list(dict.fromkeys([id_col, *names]))
    indexed = dense_index(df.select(*columns) if len(names) == len(order) else df, order)
    return indexed.groupBy(F.col(id_col).alias("id")).agg(F.max("row_index").alias("row_index"))
