"""Operator 3: shards by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the document's key and the child's name, and the
smallest draw wins. Raising one child's weight only lowers that child's draw, so documents
move only into subtrees whose weight grew. New capacity enters as a subtree of its own, so one
more shard takes documents only into itself.

Nulls: a null key hashes like any constant, a null text counts no bytes. Repeated rows stay,
each with a slot of its own. An empty table gives an empty result. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked


@dataclass(frozen=True)
class Topology:
    """Leaves as (region, rack, shard, weight); names are integers, shards are unique."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def uniform(regions: int, racks: int, shards: int) -> "Topology":
        """``regions * racks * shards`` shards of weight 1, numbered from 0."""
        return Topology(tuple(((i // shards) // racks, (i // shards) % racks, i, 1.0) for i in range(regions * racks * shards)))

    def with_shard(self, weight: float = 1.0) -> "Topology":
        """One more shard, in a region of its own."""
        region = 1 + max((r for r, *_ in self.leaves), default=-1)
        shard = 1 + max((s for _, _, s, _ in self.leaves), default=-1)
        return Topology((*self.leaves, (region, 0, shard, weight)))

    def children(self, path: tuple[int, ...]) -> dict[int, float]:
        """Weights of the children below ``path`` (a subtree weighs what its leaves weigh)."""
        found: dict[int, float] = {}
        for leaf in self.leaves:
            if leaf[: len(path)] == path:
                found[leaf[len(path)]] = found.get(leaf[len(path)], 0.0) + leaf[3]
        return found


def _draw(key: Column, path: tuple[int, ...], child: int, weight: float) -> Column:
    """The child's draw and its name; only the hash depends on the row."""
    bits = F.shiftrightunsigned(F.xxhash64(key, *[F.lit(int(p)) for p in (*path, child)], F.lit(len(path))), 11)
    unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child"))


def _winner(key: Column, path: tuple[int, ...], weights: dict[int, float]) -> Column:
    draws = [_draw(key, path, child, weight) for child, weight in sorted(weights.items())]
    return draws[0]["child"] if len(draws) == 1 else F.least(*draws)["child"]


def place(df: DataFrame, key: str, topology: Topology, name: str) -> DataFrame:
    """Add ``name``: the shard of each row's ``key``; each level draws only below the winner."""

    region, rack = f"_{name}_region", f"_{name}_rack"
    own = F.col(key)
    regions = topology.children(())
    df = df.withColumn(region, _winner(own, (), regions))
    df = df.withColumn(rack, _pick(F.col(region), {r: _winner(own, (r,), topology.children((r,))) for r in regions}))
    # a rack's name for the next level: region and rack in one number
    wide = 1 + max(k for _, k, *_ in topology.leaves)
    racks = {r * wide + k: _winner(own, (r, k), topology.children((r, k))) for r in regions for k in topology.children((r,))}
    df = df.withColumn(rack, F.col(region) * wide + F.col(rack))
    return df.withColumn(name, _pick(F.col(rack), racks).cast("int")).drop(region, rack)


def _pick(at: Column, branches: dict[int, Column]) -> Column:
    """The branch whose number ``at`` has; the others are not evaluated."""
    chain = None
    for number, branch in sorted(branches.items()):
        chain = F.when(at == number, branch) if chain is None else chain.when(at == number, branch)
    return chain


def shard_documents(docs: DataFrame, topology: Topology, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Sizes, checksums, shards now and with one shard more, and gapless slots per shard."""
    own = F.coalesce(F.col(text), F.lit(""))
    keys = place(docs.select(key), key, topology, "shard")
    rows = docs.select(key, (F.octet_length(own) + 16).cast("long").alias("size"), F.crc32(own.cast("binary")).alias("text_crc32"))
    rows = place(place(rows, key, topology, "shard"), key, topology.with_shard(), "grown_shard")
    return ranked(rows, ["shard"], [key], "slot", buckets, keys)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_documents(docs, Topology.uniform(4, 2, 5))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
