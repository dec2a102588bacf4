"""Per-key building blocks that hold when one key owns a third of all rows.

* first / last row per key: `row_number() = 1`, which Spark prunes to one row per
  key and task before the shuffle (WindowGroupLimit);
* facts per key (first matching position, owner row): aggregated per slice of
  `SLICE` positions, carried over the slices, joined back on (key, slice);
* ordered strings per key: built per slice, then the few slice strings of a key are
  joined in order, so no task sorts more than `SLICE` values. A slice is a run of
  positions; how many a key has shows nowhere in the result.

Null keys are keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = 10_000


def one_per_key(df: DataFrame, keys: list, order: list, distinct_blank: Column | None = None) -> DataFrame:
    """The first row per key in `order`; rows where `distinct_blank` is set all stay."""
    parts = list(keys) + ([distinct_blank] if distinct_blank is not None else [])
    window = Window.partitionBy(*parts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def key_set(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys, for a semi or anti join.

    Repeated keys combine map-side. Grouping by a hash as well leaves the result
    partitioned by more than the key, so the join adds a shuffle of its own (keys only)
    and the adaptive skew join can split a hot key on the other side.
    """
    return df.select(key, F.xxhash64(key).alias("_h")).distinct().select(key)


def slice_of(order, size: int = SLICE) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def sliced(df: DataFrame, order: str, size: int = SLICE) -> DataFrame:
    return df.withColumn("part", slice_of(order, size))


def with_first_match(df: DataFrame, keys: list[str], order: str, condition: Column, name: str,
                     size: int = SLICE) -> DataFrame:
    """Add the smallest `order` per key where `condition` holds (null if it never does)."""
    rows = sliced(df, order, size)
    per_slice = rows.groupBy(*keys, "part").agg(F.min(F.when(condition, F.col(order))).alias("_m"))
    carried = per_slice.withColumn(name, F.min("_m").over(Window.partitionBy(*keys))).drop("_m")
    return join_null_safe(rows, carried, [*keys, "part"])


def with_last_match(df: DataFrame, keys: list[str], order: str, condition: Column, name: str,
                    size: int = SLICE) -> DataFrame:
    """Add the largest `order` at or before each row where `condition` holds."""
    rows = sliced(df, order, size).withColumn("_hit", F.when(condition, F.col(order)))
    per_slice = rows.groupBy(*keys, "part").agg(F.max("_hit").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*keys, "part", F.max("_m").over(before).alias("_carry"))
    inside = (Window.partitionBy(*keys, "part").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumn("_local", F.max("_hit").over(inside))
    return (join_null_safe(local, carried, [*keys, "part"])
            .withColumn(name, F.coalesce("_local", "_carry")).drop("_hit", "_local", "_carry"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key; the columns of `left`, then the others of `right`."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, match).drop(*[f"_right_{k}" for k in keys])


def whole(parts: DataFrame, keys: list[str], texts: list[str], sep: str) -> DataFrame:
    """One row per key: the texts of its parts joined in order, empty ones left out."""
    joined = [ordered_concat(F.when(F.col(t) != "", F.col(t)), "part", sep).alias(t) for t in texts]
    return parts.groupBy(*keys).agg(*joined)


def ordered_concat(value: Column, order: str, sep: str) -> Column:
    """Aggregate: values of a bounded group joined in `order`; null values are left out."""
    entries = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.concat_ws(sep, F.transform(entries, lambda e: e["v"]))
