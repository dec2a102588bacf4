"""Operator 11: whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Entries become integers, so sums and deviations are exact. Two passes over the rows give their sums and
their centred covariance as sums per task; only one dimension x dimension matrix reaches the driver. There
the polar factor U of the covariance less a shift (dynamically weighted Halley steps, by QR or Cholesky)
gives the projector (U + I) / 2 of all eigenvalues above the shift; it splits the space in two, and each
half is split again until single components are left. Halves that hold no wanted component stay whole.
The components are broadcast, and a last pass projects every row.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SCALE, SHIFT = 1024, 100_000
#: Entries from here on, like non-finite ones, have no place among the integers that are summed.
LARGEST = float(1 << 40)
#: Rows that are worked on at a time: so many entries below `LARGEST` have a sum that a long holds.
ROWS = 4096
EPS = np.finfo(float).eps


# ---------------------------------------------------------------------------
# Spectral divide and conquer
# ---------------------------------------------------------------------------


def polar_factor(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix: its eigenvalues become their signs."""
    x = a / np.linalg.norm(a)
    eye = np.eye(len(a))
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # no singular value is smaller
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS * EPS), 1.0)
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
            moved = (q / r) * x + (p - q / r) / np.sqrt(r) * basis[:len(a)] @ basis[len(a):].T
        else:
            lower = np.linalg.cholesky(eye + r * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            moved = (q / r) * x + (p - q / r) * np.linalg.solve(lower.T, half).T
        moved = (moved + moved.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        change, x = np.linalg.norm(moved - x), moved
        if change <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            break
    return x @ (1.5 * eye - 0.5 * (x @ x))  # one Newton-Schulz step takes off the last rounding


def _halves(a: np.ndarray, norm: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the two invariant subspaces either side of a shift."""
    size, diagonal = len(a), np.diag(a)
    narrow, wide = diagonal.min(), diagonal.max()
    best, least = None, np.inf
    for turn in range(40):
        if turn == 0:
            shift = np.median(diagonal)
        elif turn == 1:
            shift = diagonal.mean()
        else:  # a shift that meets an eigenvalue gives no projector
            shift = np.trace(a) / size + (rng.random() - 0.5) * max(wide - narrow, np.linalg.norm(a - np.diag(diagonal))) / 2
        moved = a - shift * np.eye(size)
        if not np.any(moved):
            continue
        projector = (polar_factor(moved) + np.eye(size)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < size:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((size, rank)), mode="complete")[0]
        basis = np.linalg.qr(projector @ basis[:, :rank], mode="complete")[0]
        above, below = basis[:, :rank], basis[:, rank:]
        rest = np.linalg.norm(below.T @ a @ above)
        if rest < least:
            best, least = (above, below), rest
        if rest <= 8 * size * EPS * norm:
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Vectors of equal eigenvalues are any basis of their space. Each vector's entry of largest size is positive.
    """
    v = np.asarray(v, float)
    norm, rng = np.linalg.norm(v), np.random.default_rng(11)
    found: list[np.ndarray] = []
    stack = [np.eye(len(v))] if len(v) else []
    while stack and len(found) < k:
        basis = stack.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        if len(a) == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= 4 * EPS * norm:
            found += [basis[:, i] for i in np.argsort(-np.diag(a), kind="stable")]
            continue
        above, below = _halves(a, norm, rng)
        stack += [basis @ below, basis @ above]  # the larger eigenvalues come off first
    vectors = np.array(found[:k]).T.reshape(len(v), -1)
    if vectors.shape[1]:
        vectors, _ = np.linalg.qr(vectors)
        vectors *= np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------


def _blocks(column: pa.Array, size: int):
    """The integers of a batch's vectors, a bounded number of rows at a time, with their first row."""
    for start in range(0, len(column), ROWS):
        part = column.slice(start, ROWS)
        entries = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield start, np.floor(SCALE * entries).astype(np.int64).reshape(len(part), size) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of n * x - S; null where a long cannot hold one."""
    near = n * x.astype(float) - np.array(sums, float)
    if max(np.abs(n * x.astype(float)).max(initial=0), max(map(abs, sums), default=0)) < 2.0 ** 61 and (near * near).sum(axis=1).max(initial=0) < 2.0 ** 61:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has finite entries only, all below `LARGEST`."""
    return df.where(F.col(vector).isNotNull() & F.forall(
        F.coalesce(F.col(vector), F.array()), lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < LARGEST), F.lit(False))))


def _summed(rows: DataFrame, size: int, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of the matrix of doubles that `work` makes of one."""
    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            for _, x in _blocks(batch.column(0), size):
                total += work(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["at", "part"])

    sums = (rows.mapInArrow(partial, "at int, part array<double>").select("at", F.posexplode("part").alias("pos", "value"))
            .groupBy("at", "pos").agg(F.sum("value").alias("value")).collect())
    out = np.zeros(shape)
    for r in sums:
        out[r["at"], r["pos"]] = r["value"]
    return out


def _exact_sums(rows: DataFrame, size: int) -> list[int]:
    def partial(batches):
        total = [0] * size
        for batch in batches:
            for _, x in _blocks(batch.column(0), size):
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(map(Decimal, total)), pa.decimal128(38, 0))], ["at", "part"])

    sums = rows.mapInArrow(partial, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = [0] * size
    for r in sums:
        out[r["at"]] = int(r["part"])
    return out


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`: one row per usable vector and component.

    The fit reads all usable rows. Rows with a null vector, or with an entry that is null, not finite or of
    size 2^40 and more, are left out, and so are vectors of another length than the most frequent one (of
    equally frequent ones the longest). Null ids and repeated rows stay, each as a row of its own. Components
    whose eigenvalue is not above rounding are left out (one vector, or equal vectors, give no rows), and so
    an empty table gives an empty result. A deviation too large for a long is null. Other columns are ignored.
    The driver holds matrices of dimension x dimension, whatever the number of rows.
    """
    common.ship(df.sparkSession)
    schema = (f"{id_col} {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    kept = usable(df, vector).select(id_col, vector)
    lengths = kept.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is None or lengths["size"] == 0:
        return df.sparkSession.createDataFrame([], schema)
    size, n = lengths["size"], lengths["n"]
    kept = kept.where(F.size(vector) == size)
    alone = kept.select(vector)
    sums = _exact_sums(alone, size)
    mean = np.array([s / n for s in sums])

    def square(x):
        y = x - mean
        return y.T @ y

    v = _summed(alone, size, square, (size, size)) / n
    v = (v + v.T) / 2
    values, vectors = components(v, k)
    real = values > size * EPS * np.trace(v)
    values, vectors = values[real], vectors[:, real]
    found = len(values)
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    weights = vectors / np.sqrt(values)

    def spread(x):
        z = (x - mean) @ weights
        return np.vstack([z.T @ z, z.sum(axis=0)])

    held = _summed(alone, size, spread, (found + 1, found)) / n
    error = float(np.abs(held[:-1] - np.outer(held[-1], held[-1]) - np.eye(found)).max())
    explained = values / np.trace(v)
    fitted = df.sparkSession.sparkContext.broadcast((mean, weights))

    def project(batches):
        mean, weights = fitted.value
        for batch in batches:
            for start, x in _blocks(batch.column(1), size):
                rows = len(x)
                ids = batch.column(0).slice(start, rows).take(pa.array(np.repeat(np.arange(rows), found)))
                deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), found)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)), pa.array(np.full(rows * found, n)),
                    deviation, pa.array(((x - mean) @ weights).ravel()), pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * found, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(project, schema)


def op11_whitening(spark, sf):
    return whiten(common.table(spark, sf, "embeddings"))
