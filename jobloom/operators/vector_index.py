"""Approximate nearest vectors: coarse centroids, several lists per query, scores of whole vectors.

Centroids are fitted on a bounded sample; every vector is in the list of its nearest centroid. A query is
compared with the vectors of the lists whose centroids are nearest to it, so work falls from queries x vectors to
about `probes / lists` of that. `similar_topk` stays as the exact route, and `recall` measures this one against it.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .vectors import MAX_BLOCK_ROWS, _matrix, _ranked, _scored

# The helpers below run on executors; send them along instead of asking for an install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most centroids: they travel with the tasks (4,096 x 384 floats are 6 MB).
MAX_LISTS = 4096
ROUNDS = 8


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def fit_centroids(vectors: DataFrame, lists: int | None = None, sample: int = 20_000) -> np.ndarray:
    """Unit centroids of `vectors(id, embedding)` by spherical k-means on about `sample` rows, chosen by a hash.

    Equal vectors count once, so a vector with any share of the rows takes one centroid at most. Without
    `lists`, their number is the square root of the number of rows.
    """
    total = vectors.count()
    lists = lists or max(1, min(MAX_LISTS, math.isqrt(total)))
    share = min(1.0, sample / max(total, 1))
    kept = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    drawn = vectors.where("embedding is not null").where(kept).select("embedding").distinct()
    # a bound beside the expected share; the order makes reruns agree
    rows = drawn.orderBy(F.xxhash64("embedding"), "embedding").limit(2 * sample).toPandas()
    if rows.empty:
        return np.zeros((0, 0), np.float32)
    x = _unit(_matrix(rows["embedding"]))
    centroids = x[np.random.default_rng(7).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        used = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(used[:, None], _unit(sums), centroids)
    return centroids.astype(np.float32)


def _nearest(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """`df` with `list`, one row for each of its `probes` nearest centroids."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lists(column: pd.Series) -> pd.Series:
        near = shared.value
        out = []
        for start in range(0, len(column), 1024):
            cosines = _matrix(column.iloc[start:start + 1024]) @ near.T
            out.extend(np.argsort(-cosines, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(out)

    return df.withColumn("list", F.explode(lists("embedding")))


def similar_indexed(queries: DataFrame, vectors: DataFrame, k: int, lists: int | None = None, probes: int = 16,
                    sample: int = 20_000, rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """`(query_id, id, score, rank)`: the k vectors with the largest dot product among those of `probes` lists.

    For unit vectors. Every vector is indexed; with `probes` of at least the number of lists the result is
    exact. Lists and the queries that probe them are dealt to blocks of about `rows` together, so a list with
    any share of the rows, such as copies of one vector, is many bounded tasks. Null vectors are never found and
    null queries find nothing; empty tables give an empty result.
    """
    # columns of their own, as both sides may come from one table
    q = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding")).where("embedding is not null")
    v = vectors.select(F.col("id").alias("id"), F.col("embedding").alias("embedding")).where("embedding is not null")
    schema = "query_id {}, id {}, score double".format(dict(q.dtypes)["query_id"], dict(v.dtypes)["id"])
    centroids = fit_centroids(v, lists, sample)
    if not len(centroids):
        return _ranked(q.sparkSession.createDataFrame([], schema), k)
    asked, held = _nearest(q, centroids, min(probes, len(centroids))), _nearest(v, centroids, 1)
    # one row per list, MAX_LISTS at most
    half = max(1, rows // 2)
    many = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / half).cast("int").alias(name))
    blocks = F.broadcast(many(held, "v_blocks").join(many(asked, "q_blocks"), "list"))
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(blocks, "list").select(
        "query_id", "embedding", "list", block("query_id", F.col("q_blocks")).alias("qb"), every("v_blocks").alias("vb"))
    right = held.join(blocks, "list").select(
        "id", "embedding", "list", block("id", F.col("v_blocks")).alias("vb"), every("q_blocks").alias("qb"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _scored(a["query_id"].to_numpy(), _matrix(a["embedding"]), b, k)

    found = left.groupBy("list", "qb", "vb").cogroup(right.groupBy("list", "qb", "vb")).applyInPandas(score, schema)
    return _ranked(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """`queries, wanted, hits, recall`: how many of the exact `(query_id, id)` rows were found; one row."""
    right = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return right.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"),
                     (F.count("hit") / F.count("*")).alias("recall"))
