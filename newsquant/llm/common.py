"""Shared pieces of the training-data operators: scratch tables, components, ranks.

Nothing here holds rows on the driver: scratch tables live in the folder that
``spark.checkpoint.dir`` names, connected components are iterated joins, and ranks come
from per-bucket counts.
"""

from __future__ import annotations

import gc
import string
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word separators of every contract: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: A-Z lower-cased, letters, digits and all bytes beyond ASCII kept, other bytes a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_bytes(text: str | None) -> bytes:
    """UTF-8 of a text's plain words (runs of letters, digits and characters beyond ASCII, A-Z lower-cased), apart by spaces."""
    return (text or "").encode().translate(_PLAIN)


def plain_words(text: str) -> Column:
    """The words of :func:`plain_bytes` as an array, by built-in functions; none for null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    flat = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def pieces(plain: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """``plain`` cut at spaces, about ``most`` bytes each."""
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + most)
        end = len(plain) if end < 0 else end
        yield plain[at:end]
        at = end


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """Like :meth:`save`, dealt by ``column``: later groupings and joins on it need no shuffle."""
        self.n += 1
        path, name = f"{self.base}/{self.n}", f"scratch_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, column).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_name = path, name
        self.release()
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if name := getattr(table, "_scratch_name", None):
                self.spark.sql(f"drop table if exists {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let shuffle files of finished steps go: Spark deletes them when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)`` -> ``(id, component)``, the smallest id reachable.

    Each round takes the smallest label among neighbours and then jumps to the label's own
    label, so chains shrink geometrically; it ends when no label changes. Labels and edges are
    distributed tables; a hub's edges are pre-aggregated by ``min`` before they shuffle.
    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = (
            both.join(labels, both["a"] == labels["id"])
            .groupBy(F.col("b").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        step = scratch.save(step)
        jump = step.select(F.col("id").alias("low"), F.col("low").alias("jumped"))
        new = scratch.save(step.join(jump, "low").select("id", F.least("low", "jumped").alias("component"), (F.least("low", "jumped") != F.col("component")).alias("moved")))
        scratch.free(labels, step)
        labels = new
        if not labels.where("moved").limit(1).count():
            scratch.free(both)
            return labels.select("id", "component")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int, keys: DataFrame | None = None) -> DataFrame:
    """Add ``name``: a gapless rank from 0 within ``group``, whatever the group's size.

    Rows of a group are dealt to ``buckets`` by a hash of ``order``; a rank is the row number in
    the bucket plus the counts of the buckets before it, so no task holds a whole group.
    ``keys`` may be a cheaper frame with the same ``group`` and ``order`` values, for the counts.
    """
    deal = F.pmod(F.xxhash64(*order), F.lit(buckets))
    counts = (keys if keys is not None else df).withColumn("_deal", deal).groupBy(*group, "_deal").count()
    before = Window.partitionBy(*group).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_deal").alias("_at"), F.coalesce(F.sum("count").over(before.partitionBy(*group)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_deal").orderBy(*order)
    dealt = df.withColumn("_deal", deal).withColumn("_row", F.row_number().over(inside))
    on = [dealt[c].eqNullSafe(starts[f"_{c}"]) for c in group] + [dealt["_deal"] == starts["_at"]]
    cond = on[0]
    for more in on[1:]:
        cond = cond & more
    return dealt.join(starts, cond).withColumn(name, (F.col("_row") - 1 + F.col("_start")).cast("long")).select(*df.columns, name)


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole runs of equal ``keys`` from sorted batches, with the runs' first rows.

    A run that a batch cuts is carried over, so memory holds one batch and one run.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        ends = batch[keys].iloc[[0, -1]]
        if (len(held) > 1 and (held[0][keys].iloc[-1] == ends.iloc[-1]).all()) or (len(held) == 1 and (ends.iloc[0] == ends.iloc[-1]).all()):
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else batch.reset_index(drop=True)
        starts = _starts(frame, keys)
        yield frame.iloc[: starts[-1]], starts[:-1]
        held = [frame.iloc[starts[-1] :].reset_index(drop=True)]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, _starts(frame, keys)


def _starts(frame: pd.DataFrame, keys: list[str]) -> list[int]:
    new = np.zeros(len(frame), dtype=bool)
    new[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new).tolist()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
