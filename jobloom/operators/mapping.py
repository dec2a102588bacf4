"""Source tables to one master table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text
from ..schemas import INSTITUTIONS, MASTER_COLUMNS, SOURCE_LABELS, SOURCES, Source


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns in order: missing ones `''`, nulls `''`, extras dropped.

    `keep` names technical columns (order, rank) carried along in front.
    """
    present = set(df.columns)

    def column(f: T.StructField) -> str:
        blank = "false" if isinstance(f.dataType, T.BooleanType) else "''"
        return f"coalesce(`{f.name}`, {blank}) AS `{f.name}`" if f.name in present else f"{blank} AS `{f.name}`"

    return df.selectExpr(*[c for c in keep if c in present], *[column(f) for f in schema])


def source_label(key: str) -> Column:
    return F.lit(SOURCE_LABELS[key])


def _institution(source: Source) -> Column:
    if source.institution == "constant":
        return F.lit(INSTITUTIONS[source.key])
    row = text.clean("institution")
    if source.institution == "default":
        return F.coalesce(text.non_empty(row), F.lit(INSTITUTIONS[source.key]))
    return row


def _other_information() -> Column:
    return text.labelled_concat([
        text.clean("special_instructions"),
        text.clean("physical_demands"),
        text.prefixed("FTE: ", "fte"),
        text.prefixed("FLSA: ", "flsa"),
        text.prefixed("Work schedule: ", "work_schedule"),
    ])


def _background_check() -> Column:
    return text.flag_labels({"position_of_trust": "Position of Trust", "p_card_required": "P-Card Required"})


def to_master(df: DataFrame, key: str, keep: tuple[str, ...] = ("source_rank", "ord")) -> DataFrame:
    """One source's raw table in master columns; a single projection."""
    source = SOURCES[key]
    special = {"institution": _institution(source), "source": source_label(key)}
    special |= {c: F.lit("") for c in source.blank}
    if key == "s0":
        special |= {"other_information": _other_information(), "background_check": _background_check()}
    columns = [special.get(c, text.clean(source.renames.get(c, c))).alias(c) for c in MASTER_COLUMNS]
    return df.select(*[c for c in keep if c in df.columns], *columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, frames)


def union_sources(raw: dict[str, DataFrame]) -> DataFrame:
    """All sources mapped to master columns, tagged with source key and rank."""
    frames = []
    for key, source in SOURCES.items():
        if key in raw:
            df = raw[key].withColumn("source_rank", F.lit(source.rank))
            frames.append(to_master(df, key).withColumn("source_key", F.lit(key)))
    return union_all(frames)
