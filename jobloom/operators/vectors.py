"""Text to vectors, and exact nearest vectors."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.text import clean, job_text
from ..functions.vectors import l2_normalise
from ..session import checkpointed, fresh_path
from .ranks import dense_index

# The helpers below run on executors; send them along instead of asking for an install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 384          # fixed value: width of the published vectors
MAX_BLOCK_ROWS = 20_000
QUERY_STEP = 256
DIRECTIONS = 16
#: Share of the squared lengths by which a reach is widened, well over the error of float64 sums.
SLACK = 1e-12


def embed(site: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None,
          dimensions: int = DIMENSIONS) -> DataFrame:
    """Add `embedding`, the unit vector of each job's text.

    `encoder` maps a batch of texts to a matrix and runs on Arrow batches; without
    one, hashed term counts are built on the JVM.
    """
    texts = site.withColumn("_text", job_text("title", "department", "summary"))
    if encoder is None:
        from pyspark.ml.feature import HashingTF
        from pyspark.ml.functions import vector_to_array

        tokens = texts.withColumn("_words", F.split(F.lower(clean("_text")), " "))
        hashed = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(tokens)
        raw = hashed.withColumn("_v", vector_to_array("_tf")).drop("_words", "_tf")
    else:
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(np.asarray(encoder(batch.tolist()), dtype=np.float32)))

        raw = texts.withColumn("_v", encode("_text"))
    return raw.withColumn("embedding", l2_normalise("_v")).drop("_text", "_v")


def with_row_index(vectors: DataFrame, order: list[str]) -> DataFrame:
    """Vectors with their dense row number, for publishing.

    The vectors travel with the sort, so rows that tie in `order` or lack it keep one number each (nulls first).
    """
    return dense_index(vectors, order)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: score descending, then id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _scored(query_ids: np.ndarray, matrix: np.ndarray, batch: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one batch for each query, a few queries at a time."""
    # text ids as fixed-width text, so that they sort by code point
    ids, rows, found = np.array(batch["id"].tolist()), _matrix(batch["embedding"]).T, []
    for start in range(0, len(query_ids), QUERY_STEP):
        step = slice(start, start + QUERY_STEP)
        for query, scores in zip(query_ids[step], matrix[step] @ rows):
            best = _best(ids, scores, k)
            found.append((np.full(len(best), query), ids[best], scores[best]))
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "id", "score"), zip(*found))})


def similar_topk(queries: DataFrame, vectors: DataFrame, k: int, rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """`(query_id, id, score, rank)`: the k vectors with the largest dot product, exact; ids keep their type.

    Queries and vectors are dealt to blocks of about `rows` together; every query block meets every vector block in a
    bounded task of matrix products, which keeps k rows per query. With many blocks on both sides, vectors are first
    cut into slices along one direction, and a query meets only those that can hold a row as good as the k it has from
    its own slice. That saves most of the work where these k are nearly as good as any row could be (each vector's
    own, k = 1); elsewhere work grows with queries x vectors.
    """
    q, v = queries.select("query_id", "embedding"), vectors.select("id", "embedding")
    q_blocks, v_blocks = (max(1, -(-2 * df.count() // rows)) for df in (q, v))
    found = _sliced(q, v, k, rows) if min(q_blocks, v_blocks) > 1 else None
    return _ranked(_blockwise(q, v, k, q_blocks, v_blocks) if found is None else found, k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _blockwise(q: DataFrame, v: DataFrame, k: int, q_blocks: int, v_blocks: int) -> DataFrame:
    """Every (query block, vector block) pair is one bounded task."""
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    left = q.select("*", block("query_id", q_blocks).alias("qb"),
                    F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)).cast("array<bigint>")).alias("vb"))
    right = v.select("*", block("id", v_blocks).alias("vb"),
                     F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")).alias("qb"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a["query_id"].to_numpy()[:0], "id": b["id"].to_numpy()[:0], "score": np.zeros(0)})
        return _scored(a["query_id"].to_numpy(), _matrix(a["embedding"]), b, k)

    kinds = dict(q.dtypes)["query_id"], dict(v.dtypes)["id"]
    return (left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb"))
            .applyInPandas(score, "query_id {}, id {}, score double".format(*kinds)))


def _directions(dimensions: int) -> np.ndarray:
    """Orthonormal columns: the distance of two vectors along them is never larger than their distance."""
    return np.linalg.qr(np.random.default_rng(7).normal(size=(dimensions, min(DIRECTIONS, dimensions))))[0]


def _wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64)


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places along all directions, and squared lengths; a few rows at a time are widened."""
    directions, low, square = _directions(x.shape[1]), [], []
    for start in range(0, len(x), 4 * QUERY_STEP):
        part = _wide(x[start:start + 4 * QUERY_STEP])
        low.append(part @ directions)
        square.append((part * part).sum(axis=1))
    return np.concatenate(low), np.concatenate(square)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sketch(column: pd.Series) -> pd.Series:
    """Place along the first direction, and squared length."""
    if column.empty:
        return pd.Series([], dtype=object)
    low, square = _places(np.stack(column.to_numpy()))
    return pd.Series(list(np.stack([low[:, 0], square], axis=1)))


def _along(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A slice in order of the first direction: its rows, their vectors as they came, places and squared lengths."""
    x = np.stack(frame["embedding"].to_numpy())
    low, square = _places(x)
    order = np.argsort(low[:, 0], kind="stable")
    return frame.drop(columns="embedding").iloc[order], x[order], low[order], square[order]


def _reach(x: np.ndarray, low: np.ndarray, square: np.ndarray, rows: np.ndarray, rows_low: np.ndarray, k: int,
           longest: float) -> np.ndarray:
    """The distance beyond which no vector is as good as the k best of the rows next to each query.

    `2 q.v = |q|^2 + |v|^2 - |q - v|^2`, so `q.v >= t` needs `|q - v|^2 <= |q|^2 + longest - 2 t`.
    """
    kth = np.full(len(x), -np.inf)
    for start in range(0, len(x), QUERY_STEP):
        step = slice(start, start + QUERY_STEP)
        first, last = np.searchsorted(rows_low[:, 0], low[step, 0][[0, -1]])
        near = _wide(rows[max(0, first - QUERY_STEP):last + QUERY_STEP])
        if len(near) >= k:
            kth[step] = np.partition(_wide(x[step]) @ near.T, len(near) - k, axis=1)[:, len(near) - k]
    return np.sqrt(np.maximum(square + longest - 2 * kth, 0) + SLACK * (square + longest))


def _within(x: np.ndarray, low: np.ndarray, reach: np.ndarray, ids: np.ndarray, rows: np.ndarray, rows_low: np.ndarray,
            k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of the k best rows within its reach."""
    for start in range(0, len(x), QUERY_STEP):
        step = slice(start, start + QUERY_STEP)
        first = np.searchsorted(rows_low[:, 0], (low[step, 0] - reach[step]).min(), "left")
        last = np.searchsorted(rows_low[:, 0], (low[step, 0] + reach[step]).max(), "right")
        a, b = low[step], rows_low[first:last]
        near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T <= (reach[step] ** 2)[:, None]
        some = np.flatnonzero(near.any(axis=0))
        names, near = ids[first + some], near[:, some]
        for scores, mine in zip(_wide(x[step]) @ _wide(rows[first + some]).T, near):
            mine = np.flatnonzero(mine)
            best = mine[_best(names[mine], scores[mine], k)]
            yield names[best], scores[best]


def _dealt(asked: DataFrame, held: DataFrame, half: int, slices: int):
    """Queries and vectors of the same slice, the queries of a slice dealt to blocks of about `half`."""
    sizes = dict(asked.groupBy("slice").count().collect())  # one row per slice
    blocks = F.lit([-(-sizes.get(s, 0) // half) for s in range(slices)])[F.col("slice")]
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    right = held.where(blocks > 0).select(
        "id", "embedding", "slice", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block"))


def _sliced(q: DataFrame, v: DataFrame, k: int, rows: int) -> DataFrame | None:
    """The k best of every query and some more; nothing where slices do not pay, or a vector is not finite.

    Of equal vectors the k first ids are kept, as no other can be among the k best. Every query first meets the slice
    it falls into; the k best there give its reach. Queries whose reach ends in that slice are finished, the others
    meet the other slices in their reach. Slices do not pay if that is more than half of them.
    """
    spark, kinds, half = q.sparkSession, (dict(q.dtypes)["query_id"], dict(v.dtypes)["id"]), max(1, rows // 2)
    path = fresh_path(spark, "slices")
    # sorted by the hash first: vectors are compared where it is equal
    copy = F.row_number().over(Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("id"))
    first = v.withColumn("_copy", copy).where(F.col("_copy") <= k).withColumn("_sketch", _sketch("embedding"))
    first.select("id", "embedding", F.col("_sketch")[0].alias("place"), F.col("_sketch")[1].alias("square")).write.parquet(path)
    held = spark.read.parquet(path)
    total, longest = held.agg(F.count("*"), F.max("square")).first()
    if not np.isfinite(longest):
        return None
    slices = -(-total // half)
    cuts = held.approxQuantile("place", [i / slices for i in range(1, slices)], 0.25 / slices) if slices > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.float64))

    # on the JVM: no further Python worker beside the one that sketches
    slice_of = lambda place: F.size(F.filter(F.lit(bounds.tolist()), lambda bound: bound <= place)) if len(bounds) else F.lit(0)
    held = held.withColumn("slice", slice_of(F.col("place")))
    asked = q.withColumn("place", _sketch("embedding")[0]).withColumn("slice", slice_of(F.col("place"))).drop("place")

    def own(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "embedding", "slice", "reach", "low", "high", "ids", "scores"]
        if a.empty:
            return pd.DataFrame({n: [] for n in names})
        a, x, low, square = _along(a)
        if b.empty:
            reach, found = np.full(len(a), np.inf), [([], [])] * len(a)
        else:
            b, y, y_low, _ = _along(b)
            reach = _reach(x, low, square, y, y_low, k, longest)
            found = list(_within(x, low, reach, np.array(b["id"].tolist()), y, y_low, k))
        reaching = [np.searchsorted(bounds, low[:, 0] + side * reach, "right").astype(np.int32) for side in (-1, 1)]
        home = a["slice"].to_numpy()
        going = (reaching[0] < home) | (reaching[1] > home)
        kept = [e if g else None for e, g in zip(x, going)]
        ids, scores = ([list(f[i]) for f in found] for i in (0, 1))
        return pd.DataFrame(dict(zip(names, (a["query_id"].to_numpy(), kept, home, reach, *reaching, ids, scores))))

    def other(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({n: [] for n in ("query_id", "ids", "scores")})
        (a, x, low, _), (b, y, y_low, _) = _along(a), _along(b)
        found = list(_within(x, low, a["reach"].to_numpy(), np.array(b["id"].tolist()), y, y_low, k))
        ids, scores = ([list(f[i]) for f in found] for i in (0, 1))
        return pd.DataFrame({"query_id": a["query_id"].to_numpy(), "ids": ids, "scores": scores})

    hits = "query_id {0}, ids array<{1}>, scores array<double>".format(*kinds)
    met = checkpointed(_dealt(asked, held, half, len(bounds) + 1).applyInPandas(
        own, f"{hits}, embedding {dict(q.dtypes)['embedding']}, slice int, reach double, low int, high int"))
    if met.agg(F.sum((F.col("high") - F.col("low")).cast("double"))).first()[0] > q.count() * len(bounds) / 2 > 0:
        return None
    # one row per query and slice it has still to meet
    going = met.where("embedding is not null").withColumn("to", F.explode(F.expr("filter(sequence(low, high), s -> s <> slice)")))
    going = going.select("query_id", "embedding", "reach", F.col("to").alias("slice"))
    more = _dealt(going, held, half, len(bounds) + 1).applyInPandas(other, hits)
    both = met.select("query_id", "ids", "scores").union(more.select("query_id", "ids", "scores"))
    return both.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select(
        "query_id", F.col("hit.ids").alias("id"), F.col("hit.scores").alias("score"))
