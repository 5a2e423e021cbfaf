"""Operator 5: substring dedup over repeated word windows, by De Bruijn path compaction.

Windows of ``width`` words are the edges of a De Bruijn graph. (1) Every document's window
minimizers (smallest ``K``-word hash in a window) find the edges that can repeat at all: equal
windows have equal minimizers, so nothing is lost. (2) Consecutive repeatable edges with one
minimizer compact into one path; joined on their hashes, a path that an earlier document holds
whole is removed at once, so each distinct path's edges are looked at once. (3) The edges of
the remaining paths are joined singly. Spans are document coordinates, checked by two
independent hashes (96 bits), and the text is cut there.

A path or minimizer that many documents share is reduced inside each batch first: later holders
in a batch are settled there, and one row per batch goes through the shuffle.

Nulls and texts without words have no windows and keep nothing. Of equal texts the smallest id
is the source. Repeated rows of one id are one document: neither removes from the other. Rows
with a null id are one document that comes after all others; the largest long stands for it
inside, which makes the key non-null. Texts are dealt by document once, into a written table that
all passes read without a shuffle. Very long texts take memory in proportion to their length.
Columns of ``carry`` may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a minimizer; ``width - K + 1`` must be a power of two.
K = 6
_LAST = 2**63 - 1
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hashes of words; forgets all when it holds ``most``, so a task's memory is bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        from xxhash import xxh64_intdigest

        self.most, self.digest = most, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.digest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A mixed polynomial hash of each ``k`` consecutive values."""
    n = len(h) - k + 1
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * base + h[j : j + n]
    acc ^= acc >> np.uint64(31)
    acc *= _B2
    return acc ^ (acc >> np.uint64(29))


def _minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest ``K``-word hash in each window of ``width`` words."""
    low, span = _rolled(h, K, _B1), 1
    while span < width - K + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return low


def _sources(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    texts = batch.column("text").cast(pa.binary())
    for i, doc in enumerate(batch.column("doc").to_pylist()):
        yield doc, (texts[i].as_py() or b"").split()


def _settled(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted-by-(group, doc) rows: whether an earlier row of the batch has the group."""
    out = np.zeros(len(group), dtype=bool)
    out[1:] = (group[1:] == group[:-1]) & (doc[1:] != doc[:-1])
    return out


def _minimizer_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            marks, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, words in _sources(batch):
                if len(words) >= width:
                    marks.append(np.unique(_minimizers(hashes.of(words), width)))
                    docs.append(np.full(len(marks[-1]), doc, dtype=np.int64))
            mark, doc = np.concatenate(marks), np.concatenate(docs)
            order = np.lexsort((doc, mark))
            mark, doc = mark[order], doc[order]
            twice = _settled(mark, doc)
            known = twice.copy()
            known[:-1] |= twice[1:]  # all holders of what two documents of the batch hold
            first = known & ~twice  # and one of them tells the other batches
            yield pa.RecordBatch.from_pydict(
                {
                    "mark": np.concatenate((mark, mark[first])).view(np.int64),
                    "doc": np.concatenate((doc, doc[first])),
                    "known": np.concatenate((known, np.zeros(int(first.sum()), dtype=bool))),
                }
            )

    return run


def _path_rows(width: int):
    """Paths of repeatable windows: hash, coordinates and the hashes of their edges."""
    schema = pa.schema([("path", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("edges", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32())), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cols: dict[str, list[np.ndarray]] = {k: [] for k in ("path", "check", "doc", "text_hash", "start", "size", "edge", "edge2")}
            marks, text_hashes = batch.column("marks"), batch.column("text_hash").to_pylist()
            for i, (doc, words) in enumerate(_sources(batch)):
                if len(words) < width:
                    continue
                h = hashes.of(words)
                low = _minimizers(h, width)
                hit = np.flatnonzero(np.isin(low, marks[i].values.to_numpy().view(np.uint64)))
                if not len(hit):
                    continue
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (np.diff(hit) > 1) | (low[hit[1:]] != low[hit[:-1]])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(hit)))
                edge, edge2 = _rolled(h, width, _B1)[hit], _rolled(h ^ _B1, width, _B2)[hit]
                # the sequence of edges of a path is fixed by its first edge, its last edge and those between: fold all
                place = np.arange(len(hit)) - np.repeat(at, size)
                weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _B1
                cols["path"].append(np.add.reduceat((edge ^ weight) * _B2, at))
                cols["check"].append(np.add.reduceat((edge2 + weight) * _B1, at) + size.astype(np.uint64))
                cols["doc"].append(np.full(len(at), doc, dtype=np.int64))
                cols["text_hash"].append(np.full(len(at), text_hashes[i], dtype=np.int32))
                cols["start"].append(hit[at].astype(np.int32))
                cols["size"].append(size)
                cols["edge"].append(edge)
                cols["edge2"].append(edge2)
            if not cols["path"]:
                continue
            path, check, doc, text_hash, start, size, edge, edge2 = (np.concatenate(v) for v in cols.values())
            order = np.lexsort((doc, check, path))
            first = np.ones(len(order), dtype=bool)
            first[1:] = (path[order][1:] != path[order][:-1]) | (check[order][1:] != check[order][:-1])
            lowest = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            known = np.zeros(len(order), dtype=bool)
            known[order] = doc[order] != lowest  # an earlier document of the batch holds the path
            held = np.repeat(~known, size)  # settled paths travel without their edges
            offsets = np.append(0, np.cumsum(np.where(known, 0, size))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (edge[held].view(np.int64), (edge2[held] >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            out = [pa.array(path.view(np.int64)), pa.array(check.view(np.int64)), pa.array(doc), pa.array(text_hash), pa.array(start), pa.array(size.astype(np.int32)), *lists, pa.array(known)]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def removed_spans(docs: DataFrame, scratch: Scratch, width: int = 13) -> DataFrame:
    """``(doc, text_hash, start, size)``: runs of windows of ``docs(doc, text)`` that an earlier document also starts.

    ``docs`` must hold one row per distinct text, and should be dealt by ``doc``, so that texts do not
    shuffle; ``size`` windows start at words ``start`` on.
    """
    marks = docs.select("doc", "text").mapInArrow(_minimizer_rows(width), "mark long, doc long, known boolean")
    # settled rows are dealt by document too, the others by minimizer alone
    marks = marks.select("mark", "doc", F.when(F.col("known"), F.col("doc")).alias("salt"))
    group = Window.partitionBy("mark", "salt")
    marks = marks.select("mark", "doc", "salt", F.min("doc").over(group).alias("low"), F.max("doc").over(group).alias("high"))
    marks = marks.where("salt is not null or low < high").groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    marks = scratch.save(marks)
    scratch.release()

    paths = docs.join(marks, "doc").select("doc", "text", F.hash("text").alias("text_hash"), "marks")
    paths = paths.mapInArrow(_path_rows(width), "path long, check long, doc long, text_hash int, start int, size int, edges array<long>, checks array<int>, known boolean")
    paths = paths.withColumn("salt", F.when(F.col("known"), F.col("doc"))).drop("known")
    held = Window.partitionBy("path", "check", "salt")
    paths = paths.withColumn("gone", F.col("salt").isNotNull() | (F.min("doc").over(held) < F.col("doc")))
    whole = F.array(F.struct(F.col("start"), "size", F.col("doc").alias("edge"), F.col("start").alias("check"), F.lit(True).alias("gone")))
    single = F.zip_with(F.sequence(F.lit(0), F.size("edges") - 1), F.arrays_zip("edges", "checks"), lambda i, e: F.struct((F.col("start") + i).alias("start"), F.lit(1).alias("size"), e["edges"].alias("edge"), e["checks"].alias("check"), F.lit(False).alias("gone")))
    rows = paths.select("doc", "text_hash", F.explode(F.when(F.col("gone"), whole).otherwise(single)).alias("e")).select("doc", "text_hash", "e.*")
    # whole paths are settled; they pass through, dealt by their coordinates
    starts = Window.partitionBy("edge", "check")
    rows = rows.withColumn("gone", F.col("gone") | (F.min(F.when(~F.col("gone"), F.col("doc"))).over(starts) < F.col("doc")))
    return rows.where("gone").select("doc", "text_hash", "start", "size")


def _cut(width: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sources = batch.column("text").cast(pa.binary()), batch.column("source").to_pylist()
            starts, sizes = batch.column("starts").to_pylist(), batch.column("sizes").to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, source in enumerate(sources):
                text = texts[i].as_py()
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if source is False and len(words) >= width:
                    gone[0] = 1
                for a, n in zip(starts[i] or (), sizes[i] or ()):
                    gone[a] += 1
                    gone[a + n + width - 1] -= 1
                stay = np.cumsum(gone)[: len(words)] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                if n_removed[-1] == 0:
                    kept.append(text if whole else b" ".join(words))
                else:
                    kept.append(b" ".join([words[j] for j in np.flatnonzero(stay).tolist()]))
            out = [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("rest")]
            yield pa.RecordBatch.from_arrays(out, ["doc", "n_words", "n_removed", "kept", "rest"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.string()), batch.column("rest")], ["doc", "n_words", "n_removed", "kept", "rest"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, digest: bool = False, whole: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, n_words, n_removed, kept, *carry)`` per row; ``kept`` is the remaining text, words joined by one space.

    ``digest`` replaces the text by its SHA-256 in lowercase hex; ``whole`` leaves texts that lose
    nothing as they are, null ones too; ``carry`` names columns to pass through.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("none"))
    base = docs.select(F.coalesce(F.col(key), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"), rest.alias("rest"))
    # one shuffle of the texts serves all passes
    base = scratch.save_bucketed(base.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc"), "doc")
    copies = base.select("doc", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    sources = scratch.save(copies.groupBy("same").agg(F.min("doc").alias("doc")).select("doc").distinct())
    spans = removed_spans(base.select("doc", "text").join(sources, "doc", "left_semi"), scratch, width)
    spans = spans.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = scratch.save(spans.groupBy("doc").agg(F.collect_list(F.struct("text_hash", "spans")).alias("spans")))
    scratch.release()
    rows = base.join(sources.withColumn("source", F.lit(True)), "doc", "left").join(spans, "doc", "left")
    own = F.filter("spans", lambda s: s["text_hash"] == F.hash("text"))
    rows = rows.select("doc", "text", F.col("source").isNotNull().alias("source"), F.flatten(F.transform(own, lambda s: s["spans"])).alias("spans"), "rest")
    rows = rows.select("doc", "text", "source", F.col("spans.start").alias("starts"), F.col("spans.size").alias("sizes"), "rest")
    cut, schema = _cut(width, whole), f"doc long, n_words long, n_removed long, kept string, rest {base.schema['rest'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest(cut(batches)) if digest else cut(batches)

    out = rows.mapInArrow(run, schema)
    return out.select(F.nullif(F.col("doc"), F.lit(_LAST)).alias(key), "n_words", "n_removed", "kept", *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
