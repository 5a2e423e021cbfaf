"""Operator 10: SimHash near-duplicates, searched by BK-trees.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two fingerprints at most
``radius`` bits apart agree in at least one of ``radius + 1`` bit blocks, so distinct
fingerprints are dealt to shards by (block, value) and each shard builds a BK-tree: children
hang below their parent by integer Hamming distance, and a search follows only the edges whose
distance is within ``radius`` of the query's. A shard above ``shard_rows`` is dealt again by
blocks of the bits that are still free, which loses nothing. Shards are shuffled, not
broadcast: a broadcast of all fingerprints would grow with the corpus.

Nulls and texts without words get fingerprint zero and link like any other. Copies and equal
fingerprints collapse to one row before the search. Rows with a null id keep their fingerprint
and count as id null in ``min``. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, whole_runs


def fingerprint(text: str | None, k: int = 4) -> int:
    """Signed 64-bit SimHash of one text (A-Z lower-cased, ``k``-word shingles, repeats kept)."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
    words = raw.split()
    if not words:
        return 0
    if len(words) <= k:
        hashes = np.array([xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-k])).tolist()
        hashes = np.fromiter((xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return int(np.array([value], dtype=np.uint64).view(np.int64)[0])


#: bytes.split() separates at exactly space and \t to \r, as the contract does.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """``(key, fp)`` for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "fp": np.fromiter((fingerprint(t, k) for t in batch["text"]), dtype=np.int64, count=len(batch))})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key long, fp long").withColumnRenamed("key", key)


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bit positions cut into ``parts`` near-equal runs."""
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


class BKTree:
    """Integers by Hamming distance; nodes are parallel lists, edges a dict per node."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add_and_search(self, value: int, radius: int) -> list[int]:
        """Insert ``value`` and return the earlier nodes within ``radius``."""
        found: list[int] = []
        values, edges = self.values, self.edges
        if values:
            at = 0
            while True:  # where it belongs
                d = (values[at] ^ value).bit_count()
                below = edges[at].get(d)
                if below is None:
                    edges[at][d] = len(values)
                    break
                at = below
            todo = [0]
            new = len(values)
            while todo:
                at = todo.pop()
                d = (values[at] ^ value).bit_count()
                if d <= radius:
                    found.append(at)
                low, high = d - radius, d + radius
                todo.extend(child for x, child in edges[at].items() if low <= x <= high and child != new)
        values.append(value)
        edges.append({})
        return found


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (index, index) of a spanning forest of the links among ``values``."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, value in enumerate(values.view(np.uint64).tolist()):
        for j in tree.add_and_search(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def fingerprint_links(prints: DataFrame, radius: int = 4, shard_rows: int = 4000) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct ``prints(fp)`` as all links within ``radius`` do."""
    parts = radius + 1
    first = _blocks(list(range(64)), parts)

    def keys(blocks: list[list[int]], tag: int) -> F.Column:
        return F.explode(F.array(*[F.struct(F.lit(tag * parts + i).alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("bits")) for i, b in enumerate(blocks)]))

    dealt = prints.select("fp", keys(first, 0).alias("k")).select("fp", F.col("k.block").alias("block"), F.col("k.bits").alias("bits"))
    counts = dealt.groupBy("block", "bits").count().where("count > 1")
    dealt = dealt.join(counts, ["block", "bits"])
    small = dealt.where(F.col("count") <= shard_rows).select("fp", "block", "bits", F.lit(-1).alias("block2"), F.lit(0).cast("long").alias("bits2"))
    again = None
    for i in range(parts):
        free = [b for b in range(64) if b not in first[i]]
        more = dealt.where((F.col("count") > shard_rows) & (F.col("block") == i)).select("fp", "block", "bits", keys(_blocks(free, parts), 0).alias("k"))
        more = more.select("fp", "block", "bits", F.col("k.block").alias("block2"), F.col("k.bits").alias("bits2"))
        again = more if again is None else again.unionByName(more)

    shard = ["block", "bits", "block2", "bits2"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for runs, starts in whole_runs(batches, shard):
            values, left, right = runs["fp"].to_numpy(), [], []
            for a, b in zip(starts, [*starts[1:], len(values)]):
                for i, j in _forest(values[a:b], radius):
                    left.append(a + i)
                    right.append(a + j)
            yield pd.DataFrame({"a": values[left], "b": values[right]})

    dealt = small.unionByName(again)
    return dealt.repartition(*shard).sortWithinPartitions(*shard, "fp").mapInPandas(search, "a long, b long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, k: int = 4) -> DataFrame:
    """``(key, fp, component_id)`` for every row; the component is the smallest key reachable."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(with_fingerprints(docs, key, text, k))
    prints = rows.groupBy("fp").agg(F.min(key).alias("low"))
    found = components(fingerprint_links(prints.select("fp"), radius), scratch)
    grouped = prints.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = grouped.join(lowest, "component").select("fp", "component_id")
    return rows.join(by_print, "fp").select(key, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
