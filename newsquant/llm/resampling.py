"""Operator 11: importance resampling towards a target distribution, features read by Aho-Corasick.

Words are runs of letters, digits and all characters beyond ASCII, with A-Z lower-cased; features are all
runs of one to three consecutive words. The distinct words of a chunk of texts form a dictionary, each
bounded by delimiters and carrying its CRC-32 and length as payload. The automaton scans the chunk and
emits the payloads in order. As a CRC of joined strings follows from the CRCs and the length of the second,
payloads of neighbours compose to the CRC of each feature without building it, and that gives its bucket.

Texts are scanned once: buckets are written, counted over all documents, and read again for the scores.
Only the counts of ``buckets`` buckets reach the driver. A chunk and its dictionary are bounded, a longer
text is scanned in pieces and only its payloads are held. The draw sorts by range with a written row number
as last key, so rows of equal rank and id spread too.

Null, empty and wordless texts have no features, weight 0 and are never drawn. Repeated rows are documents
of their own, each with its own rank. Ties go to the smaller id, null ids last (their noise is that of an
empty id), then to any order. Only key and text are read, so other columns' names never clash. An empty table
gives an empty result; without a target every feature counts as unseen there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pieces, plain_bytes

#: Longer words (in bytes) stay out of the automaton; their payload is computed where they stand.
_LONG = 64


def scan(plain: list[bytes]) -> np.ndarray:
    """Payload of every word of some normalised pieces, in order: CRC-32, and length above 32 bits."""
    words = b" ".join(plain).split()
    automaton = ahocorasick.Automaton()
    for word in sorted(set(words)):
        if len(word) <= _LONG:
            automaton.add_word(f" {word.decode('latin-1')} ", crc32(word) | len(word) << 32)
    found = np.zeros(0, dtype=np.int64)
    if len(automaton):
        automaton.make_automaton()
        text = f" {b' '.join(words).decode('latin-1')} "
        found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
    if len(found) < len(words):
        at = [i for i, w in enumerate(words) if len(w) > _LONG]
        own = [crc32(words[i]) | len(words[i]) << 32 for i in at]
        found = np.insert(found, np.array(at) - np.arange(len(at)), np.array(own, dtype=np.int64))
    return found


def _shift(crc: int, n: int) -> int:
    """What ``crc`` adds to the CRC of a string that goes on for ``n`` bytes."""
    zeros = bytes(n)
    return crc32(zeros, crc) ^ crc32(zeros)


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """:func:`_shift` of each byte of a CRC, and of a leading space, for short lengths."""
    tables = [[[_shift(b << 8 * k, n) for b in range(256)] for k in range(4)] for n in range(_LONG + 2)]
    spaces = [_shift(crc32(b" "), n) for n in range(_LONG + 1)]
    return np.array(tables, dtype=np.uint32), np.array(spaces, dtype=np.uint32)


def _composed(left: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of each left string, a space and the word of the given CRC and size."""
    tables, spaces = _shifts()
    short = np.minimum(size, _LONG)
    out = crc ^ spaces[short]
    for k in range(4):
        out ^= tables[short + 1, k, left >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(size > _LONG):
        n = int(size[i])
        out[i] = int(crc[i]) ^ _shift(crc32(b" "), n) ^ _shift(int(left[i]), n + 1)
    return out


def feature_buckets(texts: list[str | None], buckets: int, chunk_bytes: int = 4 << 20) -> tuple[np.ndarray, list[bytes]]:
    """Words of each text, and the buckets of its features as little-endian unsigned 16-bit numbers."""
    lengths, held, size, payloads = np.zeros(len(texts), dtype=np.int64), [], 0, [np.zeros(0, dtype=np.int64)]
    for i, text in enumerate(texts):
        for piece in pieces(plain_bytes(text), chunk_bytes):
            if size + len(piece) > chunk_bytes and held:
                payloads.append(scan(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece)
            lengths[i] += len(piece.split())
    payloads.append(scan(held))
    found = np.concatenate(payloads)
    crc, word = (found & 0xFFFFFFFF).astype(np.uint32), found >> 32
    # pairs and triples of words that stand in different texts are computed too, and not read
    two = _composed(crc[:-1], crc[1:], word[1:])
    three = _composed(two[:-1], crc[2:], word[2:])
    kinds = [(x % np.uint32(buckets)).astype("<u2") for x in (crc, two, three)]
    ends = np.cumsum(lengths)
    return lengths, [b"".join(x[b - n : max(b - n, b - k)].tobytes() for k, x in enumerate(kinds)) for b, n in zip(ends, lengths)]


def with_buckets(docs: DataFrame, key: str, text: str, buckets: int, chunk_bytes: int = 4 << 20) -> DataFrame:
    """``(key, n_words, buckets)`` of every row of ``docs``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["text"].map(lambda t: len(t) if t else 0).to_numpy()
            for _, part in batch.groupby((np.cumsum(sizes) - sizes) // (2 * chunk_bytes), sort=False):
                n_words, found = feature_buckets(part["text"].tolist(), buckets, chunk_bytes)
                yield pd.DataFrame({"key": part["key"], "n_words": n_words, "buckets": found})

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)]).add("n_words", "long").add("buckets", "binary")
    return rows.mapInPandas(read, schema)


def bucket_counts(bucketed: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; tasks count before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for blob in batch["buckets"]:
                total += np.bincount(np.frombuffer(blob, dtype="<u2"), minlength=buckets)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": own, "n": total[own]})

    found = bucketed.select("buckets").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log of how much likelier each bucket is in the target, one added to each count."""
    n = float(len(raw))
    ratio = (target + 1.0) * (float(raw.sum()) + n) / ((raw + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighted(bucketed: DataFrame, gains: np.ndarray) -> DataFrame:
    sent = bucketed.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(b, dtype="<u2") for b in batch["buckets"]]
            batch = batch.drop(columns="buckets")
            yield batch.assign(n_features=[len(f) for f in found], weight=[int(sent.value[f].sum()) for f in found])

    schema = T.StructType([f for f in bucketed.schema if f.name != "buckets"]).add("n_features", "long").add("weight", "long")
    return bucketed.mapInPandas(weigh, schema)


def _ranked(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 by falling score, smaller key, for the best ``percent`` of them, null for others."""
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.save(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # partition number and place in it are the parts of _at; there are as many counts as partitions
    counts = sorted(tuple(r) for r in rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part], total = total, total + n
    if not starts:
        return rows.drop("_at").withColumn("rank", F.lit(None).cast("long"))
    before = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), F.shiftright("_at", 33))
    rank = before + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("rank", F.when(rank <= total * percent // 100, rank)).drop("_at")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)`` of every row of ``docs``.

    ``rank`` numbers the ``percent`` of rows with at least ``min_words`` words that are drawn, without
    replacement and with chances by ``weight``, through Gumbel noise that seed and key decide. ``buckets``
    is at most 65,536.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    bucketed = scratch.save(with_buckets(docs, key, text, buckets))
    aim = with_buckets(target.select(F.lit(0).alias("_key"), F.col(target_text).alias("_text")), "_key", "_text", buckets)
    gains = bucket_gains(bucket_counts(bucketed, buckets), bucket_counts(aim, buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    scored = _weighted(bucketed, gains).withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(chance))))
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()))
    scratch.free(bucketed)
    enough = F.col("n_words") >= min_words
    drawn = _ranked(scored.where(enough), scratch, percent)
    out = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
