"""Long label/value tables `(key, ord, label, value)` to wide rows.

Every operator takes a table whose key may own any share of the rows. Strings
built from many rows are made per slice of `SLICE` positions and then joined, so a
key has one row; with `by_part=True` its slices stay apart (`part`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H, labels as L
from ..functions.text import clean, norm_label
from ..session import fresh_path
from .keyed import SLICE, ordered_concat, sliced, whole, with_first_match, with_last_match


def resolve_label_exact(long: DataFrame, labels: dict[str, str]) -> DataFrame:
    return long.withColumn("field", L.resolve_exact(norm_label("label", spaces=True), labels))


def resolve_label_rules(long: DataFrame, labels: dict[str, str], rules) -> DataFrame:
    return long.withColumn("field", L.resolve_rules(norm_label("label"), labels, rules))


def classify_label_keywords(long: DataFrame, groups) -> DataFrame:
    return long.withColumn("field", L.classify_keywords(norm_label("label", spaces=True), groups))


def resolve_once_per_label(long: DataFrame, resolve: Callable[[DataFrame], DataFrame], max_bytes: int = 16 << 20) -> DataFrame:
    """What `resolve` (one of the functions above) puts into `field`, found once for each distinct label.

    The distinct labels are written to the shared folder and measured. Within `max_bytes` they are resolved there and
    sent to every task, so rows neither move nor meet a pattern; where labels are mostly unique and
    exceed it, `resolve` runs on the rows. Both give the same rows, null labels included.
    """
    spark = long.sparkSession
    path = fresh_path(spark, "labels")
    names = long.select("label")
    names.distinct().write.parquet(path)
    distinct = spark.read.schema(names.schema).parquet(path)
    size = distinct.agg(F.sum(F.coalesce(F.octet_length("label"), F.lit(0)) + 64)).first()[0] or 0
    if size > max_bytes:
        return resolve(long)
    dictionary = resolve(distinct).select(F.col("label").alias("_label"), "field")
    return (long.drop("field").join(F.broadcast(dictionary), F.col("label").eqNullSafe(F.col("_label")), "left")
            .drop("_label"))


def drop_boilerplate_sections(long: DataFrame, skipped=L.SKIPPED_SECTIONS) -> DataFrame:
    return long.where(~F.lower(F.col("label")).isin(list(skipped)) & (F.col("value") != ""))


def pivot_labels(long: DataFrame, key: str, fields: list[str], policy: str, order: str = "ord",
                 size: int = SLICE, by_part: bool = False) -> DataFrame:
    """One row per key, one column per field. `first` / `last` non-blank value wins, or all are appended.

    first and last combine map-side to one value per key and field.
    """
    usable = long.where(F.col("field").isin(fields) & (F.col("value") != ""))

    def only(name: str, c: Column) -> Column:
        return F.when(F.col("field") == name, c)

    if policy == "append":
        aggs = [ordered_concat(only(f, F.col("value")), order, " ").alias(f) for f in fields]
        parts = sliced(usable, order, size).groupBy(key, "part").agg(*aggs)
        return parts if by_part else whole(parts, [key], fields, " ")
    pick = {"first": F.min_by, "last": F.max_by}[policy]
    aggs = [F.coalesce(pick(only(f, F.col("value")), only(f, F.col(order))), F.lit("")).alias(f)
            for f in fields]
    return usable.groupBy(key).agg(*aggs)


def pack_extra(long: DataFrame, key: str, order: str = "ord", size: int = SLICE, by_part: bool = False) -> DataFrame:
    """Unresolved labels as `[Label] value` joined with ` || `."""
    extra = long.where(F.col("field").isNull() & (F.col("value") != ""))
    section = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("value"))
    parts = (sliced(extra, order, size).groupBy(key, "part")
             .agg(ordered_concat(section, order, " || ").alias("extra_sections")))
    return parts if by_part else whole(parts, [key], ["extra_sections"], " || ")


def attach_followers(long: DataFrame, key: str, is_owner: Column, order: str = "ord",
                     size: int = SLICE) -> DataFrame:
    """Add `owner`: the position of the last owner row at or before each row."""
    return with_last_match(long, [key], order, is_owner, "owner", size).drop("part")


def segment_by_heading(blocks: DataFrame, key: str = "page_id", order: str = "ord",
                       size: int = SLICE, by_part: bool = False) -> DataFrame:
    """Block rows `(key, ord, tag, text)` to `(key, section, heading, content)`.

    `section` is the position of the heading block, -1 before the first one. Sections
    without content are dropped. The blocks are read once: a heading is a block of its own section.
    """
    block = F.struct("tag", "text")
    rows = blocks.withColumn("_head", F.coalesce(H.is_heading(block), F.lit(False)))
    owned = with_last_match(rows, [key], order, F.col("_head"), "section", size)
    content = F.when(~F.col("_head") & (F.col("text") != ""), F.col("text"))
    parts = (owned.groupBy(key, F.coalesce("section", F.lit(-1)).alias("section"), "part")
             .agg(clean(ordered_concat(content, order, " ")).alias("content"),
                  F.max(F.when(F.col("_head"), H.heading_text(block))).alias("heading")))
    if by_part:
        heads = parts.where("heading is not null").select(key, "section", F.col("heading").alias("_heading"))
        named = parts.where("content <> ''").join(heads.withColumnsRenamed({key: "_key", "section": "_section"}),
                                                 F.col(key).eqNullSafe(F.col("_key")) & (F.col("section") == F.col("_section")), "left")
        return named.select(key, "section", "part", F.coalesce("_heading", F.lit("")).alias("heading"), "content")
    one = parts.groupBy(key, "section").agg(
        F.max("heading").alias("heading"), ordered_concat(F.when(F.col("content") != "", F.col("content")), "part", " ").alias("content"))
    return one.where("content <> ''").select(key, "section", F.coalesce("heading", F.lit("")).alias("heading"), "content")


def take_while(rows: DataFrame, key: str, is_stop: Column, order: str = "ord", size: int = SLICE) -> DataFrame:
    """Rows of each key before its first stop row."""
    marked = with_first_match(rows, [key], order, is_stop, "_stop", size)
    return marked.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop", "part")


def starts_with_any(column: str, stop_words: list[str]) -> Column:
    low = F.lower(F.col(column))
    test = low.startswith(stop_words[0])
    for w in stop_words[1:]:
        test = test | low.startswith(w)
    return test


# Facet names that end the institution group.
FACET_STOP_WORDS = [
    "academic faculty", "academic services", "administration", "administrative", "athletics",
    "campus services", "clinical", "communications", "computer", "facilities", "faculty", "finance",
    "graduate assistant", "human resources", "juvenile", "legal", "library", "management",
    "marketing", "nursing", "operations", "plant", "public safety", "research", "services", "staff",
    "student", "temporary", "work-study", "full-time", "part-time", "regular", "no value",
]


def join_duties(long: DataFrame, key: str, order: str = "ord", size: int = SLICE, by_part: bool = False) -> DataFrame:
    """Duty rows joined with ` | `; a share row adds `  [n% of time]` to the duty before it.

    Shares before any duty are left out. The text is the plain sequence of its
    pieces, so each part only needs to know where the key's first duty is.
    """
    label, value = norm_label("label"), clean("value")
    rows = (long.select(key, order, label.alias("label"), value.alias("value"))
            .where(F.col("label").isin(L.DUTY_LABEL, L.DUTY_SHARE_LABEL) & (F.col("value") != "")))
    is_duty = F.col("label") == L.DUTY_LABEL
    marked = with_first_match(rows, [key], order, is_duty, "_first", size)
    piece = (
        F.when(is_duty & (F.col(order) == F.col("_first")), F.col("value"))
        .when(is_duty, F.concat(F.lit(" | "), F.col("value")))
        .when(F.col(order) > F.col("_first"), F.concat(F.lit("  ["), F.col("value"), F.lit("% of time]")))
    )
    parts = (marked.where(piece.isNotNull()).groupBy(key, "part")
             .agg(ordered_concat(piece, order, "").alias("duties_responsibilities")))
    return parts if by_part else whole(parts, [key], ["duties_responsibilities"], "")
