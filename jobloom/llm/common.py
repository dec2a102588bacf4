"""What the corpus operators share: tables, whole-text batches, and words as byte spans."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

#: A word of a text, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Bytes of text that the array operators work on at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1_500_000
#: Bytes of the batches that Python workers get, and the JVM holds, inside `small_batches`.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _package() -> str:
    """This package's source as a zip file on the driver."""
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="jobloom-code-"), "jobloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once per application: workers need no install of it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        context.addPyFile(_package())
        _SHIPPED.add(context.applicationId)


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the folder all executors share: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Queries run inside give their Python workers batches of about `size` bytes (a longer row makes one of its own)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removed(*tables: DataFrame) -> None:
    """Delete tables that `saved` wrote, when their readers have written their own results and no plan needs them again."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def drawn(docs: DataFrame, share: float, *columns: str) -> DataFrame:
    """`columns` of about a share of the rows of `docs(doc_id, text, ...)`, by a hash of id and text; equal rows are drawn once.

    The few rows are dealt anew, so the scan keeps all its tasks.
    """
    rows = docs.withColumn("__drawn", F.xxhash64("doc_id", "text"))
    rows = rows.where(F.pmod("__drawn", F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30)))))
    return rows.select("__drawn", *columns).dropDuplicates(["__drawn"]).drop("__drawn")


def id_text(name: str) -> Column:
    """An integer id as decimal text; a null id as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a text is never cut."""
    n = batch.num_rows
    if not n:
        return
    offsets, _ = utf8(batch.column(batch.schema.names.index(text)))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string or binary column; null rows are empty."""
    binary = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    array = array.cast(pa.large_binary()).fill_null(b"") if binary else array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, np.int64)[array.offset:array.offset + len(array) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], held[offsets[0]:offsets[-1]]


# ---------------------------------------------------------------------------
# 64-bit fingerprints of byte spans
# ---------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20260101).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Fingerprints of any byte spans of one chunk: equal bytes have equal fingerprints."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        self._up, self._down = _powers(size)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self._up[:len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and the row each is in; no word crosses rows."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[data]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------------------
# A bounded filter of keys, to spare rows that cannot match a shuffle
# ---------------------------------------------------------------------------

#: Cells of the filter. It may let too much through when crowded, never too little.
CELLS = 1 << 23


def cell(key: str) -> Column:
    """The cell of a 64-bit key, from 1 on."""
    return F.pmod(F.col(key), F.lit(CELLS)) + 1


def cell_maps(keys: DataFrame, key: str) -> DataFrame:
    """`at, map`: the cells that are taken, 4 KB of bits for each 32,768 cells (1 MB at most)."""
    taken = keys.select(cell(key).alias("cell"))
    return taken.groupBy(F.bitmap_bucket_number("cell").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("map"))


def with_hit(rows: DataFrame, maps: DataFrame, key: str, hit: str) -> DataFrame:
    """`rows` with a boolean column: false if their key is surely not among those of the filter."""
    place = F.bitmap_bit_position(cell(key))
    held = F.conv(F.hex(F.expr("substring(__map, cast(__place div 8 + 1 as int), 1)")), 16, 10).cast("int")
    joined = rows.withColumn("__at", F.bitmap_bucket_number(cell(key))).withColumn("__place", place)
    # the filter's size is bounded, so it may be broadcast
    joined = joined.join(F.broadcast(maps.select(F.col("at").alias("__at"), F.col("map").alias("__map"))), "__at", "left")
    found = F.coalesce(F.getbit(held, F.pmod("__place", F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.withColumn(hit, found).drop("__at", "__place", "__map")
