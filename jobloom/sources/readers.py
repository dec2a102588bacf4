"""Sources: CSV tables, listing and site documents, feeds, event streams, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import clean, first_non_empty, url_id
from ..operators.mapping import conform
from ..operators.merge import dedup_listing, load_keyed
from ..operators.ranks import with_ordinal
from ..schemas import EVENT_SCHEMA, SOURCES, strings

FEED_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_source_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One source table: quoted newlines, doubled quotes, any cell size; adds `ord`.

    Columns are found by the header of their own file, missing ones and empty cells are `''`. A file
    with quoted newlines cannot be split, so large tables should come as many files.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"').option("maxCharsPerColumn", -1).option("encoding", "UTF-8")
    layouts: dict[str, list[str]] = {}
    for file, header in csv_headers(spark, path):
        layouts.setdefault(header, []).append(file)
    if not layouts:
        return spark.createDataFrame([], strings(columns)).withColumn("ord", F.lit(None).cast(
            "struct<file:string,block:bigint,pos:bigint>"))
    read = [conform(with_ordinal(reader.csv(files)), strings(columns), keep=("ord",)) for files in layouts.values()]
    return reduce(DataFrame.unionByName, read)


def csv_headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Every file of a path and its first line; only that line is read, on the driver, once per file."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out, open_ = [], [s.getPath() for s in fs.globStatus(root) or []]
    while open_:
        at = open_.pop()
        if fs.getFileStatus(at).isDirectory():
            open_ += [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
            continue
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
        stream = fs.open(at) if codec is None else codec.createInputStream(fs.open(at))
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            header = lines.readLine()
        finally:
            lines.close()
        if header is not None:
            out.append((at.toString(), header))
    return sorted(out)


def read_all_sources(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The registered sources that exist, in source order; missing ones are left out."""
    return {key: read_source_csv(spark, paths[key], source.columns)
            for key, source in SOURCES.items()
            if key in paths and path_exists(spark, paths[key])}


def read_listing_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Saved listing cards: a JSON array of objects."""
    return conform(spark.read.schema(strings(columns)).json(path, multiLine=True), strings(columns))


def read_site_document(spark: SparkSession, path: str, job_schema: T.StructType) -> DataFrame:
    """The jobs of a `{meta, jobs[]}` document."""
    document = T.StructType([T.StructField("jobs", T.ArrayType(job_schema))])
    return spark.read.schema(document).json(path, multiLine=True).select(F.inline("jobs"))


def read_feed(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Atom entries as listing cards; entries without an id are dropped, the first of an id wins."""
    entries = with_ordinal(spark.read.format("xml").option("rowTag", "entry").schema(FEED_SCHEMA).load(path))
    pid = url_id("id")
    alternate = F.get(F.filter("link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"),
                      F.lit(0))["_href"]
    cards = entries.select(
        pid.alias("posting_id"),
        first_non_empty(alternate, F.concat(F.lit(f"{base}/postings/"), pid)).alias("posting_url"),
        clean("title").alias("working_title"),
        F.substring(first_non_empty("published", "updated"), 1, 10).alias("published"), "ord")
    return dedup_listing(cards, "posting_id", ["ord"])


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA,
                options: dict | None = None) -> DataFrame:
    """A stream of JSON event files."""
    return spark.readStream.schema(schema).options(**(options or {})).json(path)


def parse_events(messages: DataFrame, column: str = "value", schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Event columns from a stream of JSON messages (a message queue source)."""
    return messages.select(F.from_json(F.col(column).cast("string"), schema).alias("e")).select("e.*")


def load_existing(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str = "ord",
                  full_refresh: bool = False) -> DataFrame:
    """The stored snapshot, one row per key; empty when missing or when all is to be fetched again."""
    if full_refresh or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return load_keyed(spark.read.schema(schema).parquet(path), key, order)
