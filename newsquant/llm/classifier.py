"""Operator 9: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made in Arrow batches. Trees are fitted on binned statistics of a
bounded sample of labelled rows (``most_rows``, by hash order of the id), grown level by level
on gradient histograms, and flattened into arrays; scoring walks all rows of a batch through a
level at once.

Null and empty texts have zero statistics and get a score like any other. Labels of ids that
occur twice count once (the highest); null labels and ids are left out. Without both classes
every score is the prior (0.5 without labels). An empty table gives an empty result. Ids,
labels, languages and sources are never inputs.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "words chars mean_word sd_word upper digit symbol pipe punct space newline unique top_word same_next lines dup_line mean_line title bang other".split()
_UPPER, _DIGIT, _SYMBOL, _PUNCT = (np.frombuffer(x, dtype=np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+\\/{}[]_", b".,;:?'\"()-"))


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of one whole text; every share is in [0, 1]."""
    own = text or ""
    raw = own.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    total, n = len(raw), len(words)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        np.log1p(total),
        sizes.mean(),
        sizes.std(),
        sum(map(str.isupper, own)) / len(own),
        bytes_[_DIGIT].sum() / total,
        bytes_[_SYMBOL].sum() / n,
        bytes_[124] / n,
        bytes_[_PUNCT].sum() / n,
        bytes_[32] / total,
        bytes_[10] / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(total / len(lines)),
        sum(w[:1].isupper() for w in words) / n,
        bytes_[33] / n,
        bytes_[128:].sum() / total,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays ``[tree, node]``; a row goes right where its value > cut."""

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        total = np.full(len(x), self.prior)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees on logistic loss; each level's splits come from gradient histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    share = y.mean() if len(y) else 0.5
    empty = Trees(float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if share in (0, 1) or not len(y) or len(y) < 2 * least:
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), empty.prior)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            place = (at - first) * bins
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                key = place + binned[:, f]
                g, h, n = (np.bincount(key, w, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1) for w in (grad, hess, None))
                rest = lambda a: a[:, -1:] - a
                gain = g**2 / (h + ridge) + rest(g) ** 2 / (rest(h) + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = np.where((n >= least) & (rest(n) >= least), gain, 0.0)[:, : len(edge)]
                pick = gain.argmax(axis=1)
                top = gain[np.arange(nodes), pick]
                better = top > best
                best = np.where(better, top, best)
                feature[first : first + nodes][better] = f
                cut[first : first + nodes][better] = edge[pick[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        at -= inner
        leaf = rate * np.bincount(at, grad, minlength=leaves) / (np.bincount(at, hess, minlength=leaves) + ridge)
        total = total + leaf[at]
        made.append((feature, cut, leaf))
    return Trees(empty.prior, *(np.stack(v) for v in zip(*made)))


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[float(v) for v in statistics(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = 8000) -> Trees:
    """Fit on at most ``most_rows`` of ``labels(key, label)``, the first by hash of the key."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("label"))
    sample = rows.orderBy(F.xxhash64(key), key).limit(most_rows)
    texts = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(sample), key)  # at most most_rows ids
    got = texts.select("label", "text").mapInArrow(_statistics_rows, "label double, x array<double>").orderBy("x").collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], dtype=np.float64))


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], dtype=np.float64).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(trees.score(x), pa.float64())], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, score double").withColumnRenamed("key", key)


def held_out(key: str) -> Column:
    """Rows that no fit may see: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
