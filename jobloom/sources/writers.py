"""Sinks: CSV, JSON lines, the site datasets, vectors, resumable appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.site import newest_site, site_meta
from ..operators.quality import count_by, loaded_counts
from ..operators.vectors import with_row_index
from .readers import path_exists


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order with a header; other columns are left out."""
    (df.select(*columns).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per line, text as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_site(master: DataFrame, path: str, last_updated: str | None = None) -> None:
    """The job dataset of a master table, newest first, and its one-row metadata dataset.

    The metadata is derived from the written jobs, so the jobs are computed once.
    """
    newest_site(master).write.mode("overwrite").parquet(f"{path}/jobs")
    stored = master.sparkSession.read.parquet(f"{path}/jobs")
    site_meta(stored, last_updated).write.mode("overwrite").json(f"{path}/meta")


def write_vectors(vectors: DataFrame, path: str, order: list[str]) -> None:
    """`(row_index, id, embedding)` as parquet."""
    (with_row_index(vectors, order).select("row_index", "id", "embedding")
     .write.mode("overwrite").parquet(path))


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the runs that share a checkpoint, kept inside it: a new checkpoint is a new run."""
    path = f"{checkpoint}/run-name"
    if not path_exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def checkpointed_append(df: DataFrame, path: str, batch: str, run: str = "0", partition_by: tuple[str, ...] = ()) -> None:
    """Add one batch of a run; writing the same batch of the same run again replaces it, so a run can resume.

    Batches of other runs are never touched. The rows are written aside and moved into place, so a batch
    that fails halfway leaves what was there before.
    """
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(aside)
    publish(df.sparkSession, aside, f"{path}/run={run}/batch={batch}")


def publish(spark: SparkSession, aside: str, target: str) -> None:
    """Put a written folder in the place of another."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(target), hadoop(aside)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(old.getParent())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot move {aside} to {target}")


def publish_master(master: DataFrame, path: str, columns: list[str]) -> dict[str, DataFrame]:
    """Write the merged table once, then derive files and counts from the written copy."""
    spark = master.sparkSession
    master.write.mode("overwrite").parquet(f"{path}/master")
    stored = spark.read.parquet(f"{path}/master")
    write_csv(stored, f"{path}/csv", columns)
    write_records(stored.select(*columns), f"{path}/json")
    return {"by_institution": count_by(stored, "institution"), "by_source": count_by(stored, "source"),
            "loaded": loaded_counts(stored)}
