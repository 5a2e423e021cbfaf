"""Operator 13: embedding whitening over the distinct vectors.

Components of a vector become fixed-point integers, so equality and sums are exact. Spark keeps each
distinct vector once, sums them, and adds up centred products per task; only the ``d * d`` sums of the
covariance reach the driver. There the matrix is made tridiagonal by Householder reflections, the leading
eigenvalues come from bisection on Sturm counts, and their vectors from inverse iteration, reorthogonalised
within clusters of close eigenvalues. The projection is broadcast and applied to all rows; a second pass
over the distinct vectors measures the covariance of what was whitened.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are empty vectors, as they
have no component. Vectors of different lengths are fitted apart, each length with its own figures; there
may be as many as ``most_dims`` dimensions (an error beyond that, as the matrix is held whole). Components
whose eigenvalue is not above rounding are not returned: a fit list of one vector, or of equal vectors,
gives no rows. Repeated rows and ids are projected row by row, null ids kept. Only key and vector are
read, so other columns' names never clash. An empty table gives an empty result. An entry whose integer is
beyond 2**52 raises an error, as ``deviation`` beyond 38 digits does.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

_EPS = float(np.finfo(np.float64).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    a = matrix.astype(np.float64).copy()
    n, mirrors = len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        size = np.sqrt(v @ v)
        if size > 0:
            v /= size
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            p -= (v @ p) * v
            rest -= 2 * (np.outer(v, p) + np.outer(p, v))
            edge = a[k + 1 :, k]
            edge -= 2 * (v @ edge) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, side: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``x``: negative pivots of the shifted matrix."""
    tiny = _EPS * max(float(np.abs(side).max(initial=0.0)), float(np.abs(diagonal).max(initial=0.0)), 1e-300)
    pivot, below = np.ones(len(x)), np.zeros(len(x), dtype=np.int64)
    for d, s in zip(diagonal, np.append(0.0, side)):
        pivot = d - x - s**2 / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    reach = np.abs(np.append(side, 0.0)) + np.abs(np.append(0.0, side))
    low, high = np.full(most, (diagonal - reach).min()), np.full(most, (diagonal + reach).max())
    width = float(high[0] - low[0])
    low, high = low - width * 4 * _EPS, high + width * 4 * _EPS
    wanted = n - np.arange(most)  # the first eigenvalue is below x once all n are
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = sturm_count(diagonal, side, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of the shifted tridiagonal system, by elimination with row exchanges."""
    n = len(diagonal)
    d, up, up2, x = diagonal - shift, np.append(side, 0.0), np.zeros(n), right.copy()
    down = side.copy()
    tiny = _EPS * max(float(np.abs(diagonal).max()), float(np.abs(side).max(initial=0.0)), 1e-300)
    for k in range(n - 1):
        if abs(down[k]) > abs(d[k]):
            d[k], down[k] = down[k], d[k]
            up[k], d[k + 1] = d[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        d[k] = d[k] if abs(d[k]) > tiny else np.copysign(tiny, d[k])
        f = down[k] / d[k]
        d[k + 1] -= f * up[k]
        up[k + 1] -= f * up2[k]
        x[k + 1] -= f * x[k]
    d[n - 1] = d[n - 1] if abs(d[n - 1]) > tiny else np.copysign(tiny, d[n - 1])
    for k in range(n - 1, -1, -1):
        x[k] -= (up[k] * x[k + 1] if k + 1 < n else 0.0) + (up2[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] /= d[k]
    return x


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    diagonal, side, mirrors = tridiagonal(matrix)
    n, most = len(diagonal), min(most, len(diagonal))
    values = leading_values(diagonal, side, most)
    scale = max(float(np.abs(diagonal).max()), float(np.abs(side).max(initial=0.0)))
    if scale == 0:
        return values, np.eye(n)[:most]
    rng, vectors, first = np.random.default_rng(13), np.zeros((most, n)), 0
    for k in range(most):
        if k and values[k - 1] - values[k] > 1e-3 * scale:
            first = k
        # eigenvalues that fall together are drawn apart by less than they are known to
        shift = values[k] - (k - first) * 4 * _EPS * scale
        x = rng.standard_normal(n)
        for _ in range(5):
            x = _solve(diagonal, side, shift, x / np.sqrt(x @ x))
            for _ in range(2):
                x -= vectors[first:k].T @ (vectors[first:k] @ x)
            x /= np.sqrt(x @ x)
        vectors[k] = x
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    return values, vectors


@dataclass(frozen=True)
class Whitening:
    """A fitted projection of the vectors of one length."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` for integer rows, rounded once."""
        return _exact(x, self.n, self.sums).astype(np.float64) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` as integers, of any size where 64 bits could be too few."""
    reach = n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(int(s)) for s in sums)
    if reach < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[Decimal]:
    off = _exact(x, n, sums)
    top = max(int(abs(off).max(initial=0)), 1)
    if off.dtype != object and top * top * off.shape[1] < 2**62:
        return [Decimal(int(v)) for v in (off * off).sum(axis=1)]
    off = off.astype(object)
    return [Decimal(int(v)) for v in (off * off).sum(axis=1)]


def _blocks(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrices of a batch, by vector length."""
    sizes = batch["x"].map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.stack(batch["x"].iloc[rows].to_list()).astype(np.int64)


def _cells(fit: DataFrame, body) -> dict[int, np.ndarray]:
    """Sums over all rows of the square matrices that ``body(x)`` gives, by vector length; ``d * d`` rows reach the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                own = body(x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + own
        for size, sums in total.items():
            i, j = np.indices(sums.shape)
            yield pd.DataFrame({"size": size, "i": i.ravel(), "j": j.ravel(), "v": sums.ravel()})

    found = fit.select("x").mapInPandas(add, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for size, part in found.toPandas().groupby("size"):
        side = int(part["i"].max()) + 1
        out[size] = np.zeros((side, side))
        out[size][part["i"], part["j"]] = part["v"]
    return out


def fit_whitening(fit: DataFrame, most: int = 16, most_dims: int = 2048) -> tuple[dict[int, Whitening], dict[int, float]]:
    """Models and their identity errors by vector length, over ``fit(x)``, distinct integer vectors."""
    sizes = fit.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    sums = fit.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "c")).groupBy("size", "i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    counts = {r["size"]: r["n"] for r in sizes.collect()}
    if any(size > most_dims for size in counts):
        raise ValueError(f"vectors of over {most_dims} dimensions")
    totals = {size: np.zeros(size, dtype=object) for size in counts}
    for row in sums.collect():
        totals[row["size"]][row["i"]] = int(row["s"])
    blank = {s: Whitening(n, totals[s], np.zeros(0), np.zeros((0, s)), 0.0) for s, n in counts.items()}

    def products(x: np.ndarray) -> np.ndarray:
        off = blank[x.shape[1]].centred(x)
        return off.T @ off

    models = {}
    for size, matrix in _cells(fit, products).items():
        matrix = (matrix + matrix.T) / (2 * counts[size])
        values, vectors = leading_components(matrix, most)
        real = values > np.trace(matrix) * max(size * 8 * _EPS, 1e-12)
        models[size] = Whitening(counts[size], totals[size], values[real], vectors[real], float(np.trace(matrix)))

    def spread(x: np.ndarray) -> np.ndarray:
        out = models[x.shape[1]].apply(x)
        return out.T @ out

    errors = {}
    for size, matrix in _cells(fit, spread).items():
        errors[size] = float(np.abs(matrix / counts[size] - np.eye(len(matrix))).max(initial=0.0))
    return models, errors


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16, most_dims: int = 2048) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row for each component of each usable row."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    own = F.col(vector).cast("array<double>")
    usable = F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(own) > 0)
    fixed = lambda c: F.when(F.abs(c) < 2.0**46, F.floor(c * 64) + 1_000_000).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    rows = scratch.save(vectors.where(own.isNotNull() & usable).select(F.col(key).alias("key"), F.transform(own, fixed).alias("x")))
    fit = scratch.save(rows.select("x").distinct())
    models, errors = fit_whitening(fit, most, most_dims)
    sent = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, errors = sent.value
        for batch in batches:
            for at, x in _blocks(batch):
                model = models[x.shape[1]]
                k = len(model.values)
                keys = batch["key"].iloc[at]
                yield pd.DataFrame(
                    {
                        "key": keys.repeat(k).array,
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                        "n": np.full(k * len(at), model.n, dtype=np.int64),
                        "deviation": [d for d in _deviation(x, model.n, model.sums) for _ in range(k)],
                        "whitened": model.apply(x).ravel(),
                        "explained": np.tile(model.values / model.trace if k else model.values, len(at)),
                        "identity_error": np.full(k * len(at), errors.get(x.shape[1], 0.0)),
                    }
                )

    schema = T.StructType([T.StructField("key", vectors.schema[key].dataType)]).add("component", "integer").add("n", "long").add("deviation", "decimal(38,0)")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    return rows.mapInPandas(project, schema).withColumnRenamed("key", key)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
