"""Operator 2: embedding near-dedup by E8 lattice hashing.

In each table a random projection takes the unit vector to 8 dimensions, where the nearest E8
lattice point is its cell. A vector also probes the ``probes`` neighbouring cells that lie
nearest, and every pair that meets is verified by cosine in double precision. Equal vectors
collapse to one representative first. Cells above ``cell_rows`` are cut into blocks and all
pairs of blocks are tried, so no task holds a whole cell. A pair that meets in several cells
is counted in the first one only; tasks return counts and a spanning forest, never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are
their own component. Vectors of other lengths never link with each other. Repeated ids count as
rows; a null id is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, whole_runs


def _e8_steps() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are integers."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            row = [0] * 8
            row[i], row[j] = a, b
            rows.append(row)
    rows += [s for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows, dtype=np.int64)


def e8_decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of ``x[n, 8]``, doubled: integers of one parity."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(axis=1)
        rows = np.flatnonzero(near.sum(axis=1) % 2)
        at = worst[rows]
        near[rows, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
        return near

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


@dataclass(frozen=True)
class LatticeHash:
    """Cells of unit vectors; the same vector gets the same cells in any batch."""

    tables: int = 8
    probes: int = 8
    scale: float = 1.5
    seed: int = 5

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """``[n, tables, 1 + probes]``: own cell, then the probed ones, as hashes."""
        n, dim = unit.shape
        rng = np.random.default_rng([self.seed, dim])
        plane = rng.standard_normal((dim, self.tables * 8)) / self.scale
        flat = np.zeros((n, self.tables * 8))
        for k in range(dim):  # elementwise, so that rounding does not depend on the batch
            flat += unit[:, k : k + 1] * plane[k]
        steps = _e8_steps()
        mix = rng.integers(1, 2**62, size=8, dtype=np.int64) * 2 + 1
        out = np.zeros((n, self.tables, 1 + self.probes), dtype=np.int64)
        for t in range(self.tables):
            x = flat[:, 8 * t : 8 * t + 8]
            own = e8_decode(x)
            rest = x - own / 2
            lean = np.zeros((n, len(steps)))
            for k in range(8):
                lean += rest[:, k : k + 1] * steps[:, k]
            near = np.argsort(-lean, axis=1, kind="stable")[:, : self.probes]
            points = np.concatenate((own[:, None, :], own[:, None, :] + steps[near]), axis=1)
            key = (points * mix).sum(axis=2)
            out[:, t] = (key ^ (key >> 29)) * np.int64(-7046029254386353131) + t
        return out


def _unit(blobs: pd.Series) -> np.ndarray:
    """Unit rows in double precision; a blob is its item size and then its components."""
    x = np.stack([np.frombuffer(b, dtype=f"<f{b[0]}", offset=1) for b in blobs]).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(blobs: pd.Series) -> Iterator[np.ndarray]:
    sizes = blobs.map(len).to_numpy()
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _links(unit_a: np.ndarray, unit_b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with cosine >= threshold of which one owns the cell."""
    cosine = unit_a @ unit_b.T
    linked = cosine >= threshold
    near = np.abs(cosine - threshold) < 1e-9
    for i, j in np.argwhere(near):  # settle the border alike in every batch shape
        linked[i, j] = float(np.sum(unit_a[i] * unit_b[j])) >= threshold
    return np.nonzero(linked & (own_a[:, None] | own_b[None, :]))


def _counted(cells_a: np.ndarray, cells_b: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Which of the pairs ``(i, j)`` count in this cell: the first one in which they meet."""
    counts = np.ones(len(i), dtype=bool)
    for a in range(0, len(i), 100_000):
        x, y = cells_a[i[a : a + 100_000]], cells_b[j[a : a + 100_000]]
        same = x[:, :, 0] == y[:, :, 0]
        x_own = (x[:, :, :1] == y).any(axis=2)  # y probes (or shares) x's own cell
        y_own = (x == y[:, :, :1]).any(axis=2)
        first = (x_own | y_own).argmax(axis=1)
        at = np.where(same | x_own, x[:, :, 0], y[:, :, 0])[np.arange(len(x)), first]
        counts[a : a + 100_000] = (first == table) & (at == cell)
    return counts


def link_vectors(vectors: DataFrame, threshold: float = 0.9, how: LatticeHash = LatticeHash(), cell_rows: int = 1500) -> DataFrame:
    """``(rep, other, n)`` rows over ``vectors(rep, weight, blob)``, distinct finite nonzero vectors.

    ``n`` sums to the linked weight of ``rep``; rows with ``other`` connect what is linked.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _by_length(batch["blob"]):
                part = batch.iloc[rows]
                cells = how.cells(_unit(part["blob"])).reshape(len(part), -1)
                wide = how.tables * (1 + how.probes)
                yield pd.DataFrame(
                    {
                        "rep": np.repeat(part["rep"].to_numpy(), wide),
                        "dim": np.repeat(part["blob"].map(len).to_numpy(), wide),
                        "tab": np.tile(np.repeat(np.arange(how.tables), 1 + how.probes), len(part)),
                        "cell": cells.ravel(),
                        "own": np.tile(np.arange(wide) % (1 + how.probes) == 0, len(part)),
                    }
                )

    place = ["dim", "tab", "cell"]
    dealt = vectors.select("rep", "blob").mapInPandas(deal, "rep long, dim int, tab int, cell long, own boolean")
    counts = dealt.groupBy(*place).agg(F.count("*").alias("rows"), F.max("own").alias("owned")).where("rows > 1 and owned")
    blocks = F.ceil(F.col("rows") / F.lit(float(cell_rows))).cast("int")
    dealt = dealt.join(counts, place).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"))))
    dealt = dealt.select("rep", *place, "own", "block", pair.alias("p")).select("rep", *place, "own", "block", "p.*")
    dealt = dealt.join(vectors.select("rep", "weight", "blob"), "rep")
    keys = [*place, "low", "high"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, starts in whole_runs(batches, keys):
            reps, weights, own, block = (runs[c].to_numpy() for c in ("rep", "weight", "own", "block"))
            for a, b in zip(starts, [*starts[1:], len(runs)]):
                if b - a < 2 or not own[a:b].any():
                    continue
                unit = _unit(runs["blob"].iloc[a:b])
                table, cell, low, high = (runs[c].iloc[a] for c in ("tab", "cell", "low", "high"))
                left = np.flatnonzero(block[a:b] == low)
                right = np.flatnonzero(block[a:b] == high)
                if not (own[a:b][left].any() or own[a:b][right].any()):
                    continue
                i, j = _links(unit[left], unit[right], own[a:b][left], own[a:b][right], threshold)
                i, j = left[i], right[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                linked, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                cells = how.cells(unit[linked])  # only of vectors that link here
                counted = _counted(cells, cells, at[: len(i)], at[len(i) :], table, cell)
                w = weights[a:b]
                n = np.bincount(i[counted], w[j[counted]], minlength=b - a) + np.bincount(j[counted], w[i[counted]], minlength=b - a)
                label = np.arange(b - a)
                while True:  # smallest index reachable among these rows
                    new = label.copy()
                    np.minimum.at(new, i, label[j])
                    np.minimum.at(new, j, new[i])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                show = np.flatnonzero((n > 0) | (label != np.arange(b - a)))
                r = reps[a:b]
                yield pd.DataFrame({"rep": r[show], "other": r[label[show]], "n": n[show].astype(np.int64)})

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInPandas(verify, "rep long, other long, n long")


def embedding_components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, how: LatticeHash = LatticeHash()) -> DataFrame:
    """``(key, n_links, component_id)`` of every row."""
    scratch = Scratch(vectors.sparkSession, "lattice")
    own = F.col(vector).cast("array<double>")
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = own.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(own, lambda x: x != 0.0)

    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType())
    kind, head = (np.float32, b"\x04") if single else (np.float64, b"\x08")

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [head + (np.asarray(v, dtype=kind) + kind(0)).tobytes() if ok else None for v, ok in zip(batch["v"], batch["ok"])]
            yield pd.DataFrame({"key": batch["key"], "blob": blobs})

    rows = vectors.select(F.col(key).alias("key"), own.alias("v"), usable.alias("ok")).mapInPandas(to_bytes, "key long, blob binary")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    reps = scratch.save(rows.where("blob is not null").groupBy("blob").agg(F.min("row").alias("rep"), F.count("*").alias("weight"), F.min("key").alias("low")))
    links = scratch.save(link_vectors(reps, threshold, how))
    n_links = links.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    known = reps.join(n_links, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("blob", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "component").select("blob", "n_links", "component_id")
    out = rows.join(known, "blob", "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = embedding_components(vectors)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
