"""Operator 7: best-fit packing planned over the histogram of lengths.

Documents are tokenised and cut to pieces of at most ``room`` ids. The plan needs only how many
pieces have each length: at most ``room`` numbers, whatever the corpus. Best-fit over these
counts fills whole groups of equal sequences at once; its planned slots are ranges of ranks
within a length. Each piece then takes the slot that its rank within its length names.

A null text is empty and has the closing id only. Repeated rows are packed like others. An
empty table gives an empty result. Null ids are kept.
"""

from __future__ import annotations

import os
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ranked


class Memory(dict):
    """What was seen of late: at ``most / 2`` entries all of them grow old, and the old ones before are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that must be learnt; old ones are taken over."""
        new = [k for k in keys if k not in self]
        if new and len(self) + len(new) > self.most // 2:
            self.old = dict(self)
            self.clear()
            new = list(keys)
        old, unknown = self.old, []
        for key in new:
            if key in old:
                self[key] = old[key]
            else:
                unknown.append(key)
        return unknown


class CachedTokenizer:
    """Ids of texts by a ``tokenizers`` file, remembering those of words and of their pieces.

    The file's normaliser and pre-tokeniser keep nothing across ASCII white space, so words between
    such spaces stand alone; a new word is normalised, cut as the file's pre-tokeniser cuts it, and
    only new pieces are encoded, many at a call: a piece ends with the token that the file marks as
    a word's end. Both memories are bounded. Texts are cut at the file's added tokens first, as the
    library does, and these give their own ids.
    """

    def __init__(self, path: str, most_words: int = 800_000, most_pieces: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        marks = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.words, self.pieces = Memory(most_words), Memory(most_pieces)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # fixed values: the pattern by which the vocabulary file splits text
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall

    def _encode(self, pieces: list[str]) -> None:
        """Add ``pieces`` to the memory."""
        parts = [pieces[a : a + 64] for a in range(0, len(pieces), 64)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark where words end")
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def learn(self, words: set[bytes]) -> None:
        """Make sure that ``words`` are in the memory."""
        new = self.words.missing(words)
        texts = [w.decode() for w in new]
        cuts = [self.cut(t.lower() if t.isascii() else self.tokenizer.normalizer.normalize_str(t)) for t in texts]
        if missing := self.pieces.missing({p for cut in cuts for p in cut}):
            self._encode(missing)
        pieces = self.pieces
        for word, cut in zip(new, cuts):
            self.words[word] = pieces[cut[0]] if len(cut) == 1 else b"".join([pieces[p] for p in cut])

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not any(mark in text for mark in self.added):
            return self._plain(text)
        parts = self.marks.split(text)  # texts at even places, added tokens at odd ones
        return np.concatenate([np.array([self.added[p]], dtype="<u4") if i % 2 else self._plain(p) for i, p in enumerate(parts)])

    def _plain(self, text: str) -> np.ndarray:
        words = text.encode().split()
        known = self.words
        try:
            raw = b"".join(map(known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            raw = b"".join(map(known.__getitem__, words))
        return np.frombuffer(raw, dtype="<u4")


def worker_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this Python worker: its memory serves the worker's later tasks too."""
    held = sys.modules.setdefault("_packing_memory", ModuleType("_packing_memory")).__dict__
    if path not in held:
        held[path] = CachedTokenizer(path)
    return held[path]


def _piece_rows(path: str, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for batch in batches:
            at, start, length, check, blobs, piece = [], [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, text in enumerate(texts):
                if i % 256 == 0:  # many texts' new words at a call
                    tokenizer.learn({w for t in texts[i : i + 256] for w in t.encode().split()})
                ids = np.append(tokenizer.ids(text), np.uint32(0)).astype("<u4")
                for n, a in enumerate(range(0, len(ids), room)):
                    raw = ids[a : a + room].tobytes()
                    at.append(i)
                    piece.append(n)
                    start.append(a)
                    length.append(len(raw) // 4)
                    check.append(crc32(raw))
                    if with_ids:
                        blobs.append(raw)
            doc = batch.column("doc").take(pa.array(at, pa.int64()))
            out = [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(blobs, pa.binary())] * with_ids, ["doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = 2048, with_ids: bool = False) -> DataFrame:
    """``(doc, piece, start, length, ids_crc32)`` and, if asked for, ``ids`` (little-endian 32-bit)."""
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(_piece_rows(path, room, with_ids), schema)


def plan_slots(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Returns ranges ``(length, first_rank, end_rank, first_sequence, each, offset)``: piece ``r`` of
    that length goes to sequence ``first_sequence + (r - first_rank) // each``, at ``offset +
    (r - first_rank) % each * length``. Work follows the number of lengths, not of pieces.
    """
    slots = []
    open_bins: dict[int, list[tuple[int, int]]] = {}  # free room -> groups (first sequence, how many)
    rooms: list[int] = []
    made = 0

    def keep(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in open_bins:
                open_bins[free] = []
                insort(rooms, free)
            open_bins[free].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):  # the fullest sequences that still have room
                free = rooms[at]
                first, many = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                    rooms.pop(at)
            else:
                free, first, many = room, made, -(-left // (room // length))
                made += many
            each = free // length
            full = min(many, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, room - free))
                rank, left = rank + full * each, left - full * each
                keep(free - each * length, first, full)
            rest = many - full
            if rest and left and left < each:
                slots.append((length, rank, rank + left, first + full, left, room - free))
                keep(free - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            keep(free, first + full, rest)
    return slots


def pack(pieces: DataFrame, room: int = 2048, buckets: int = 64) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(doc, piece, length, ...)``, lengths 1 to ``room``.

    ``pieces`` is read three times: pass a written table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``room`` rows
    slots = plan_slots(counts, room)
    plan = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "length long, first_rank long, end_rank long, first_sequence long, each long, offset0 long")
    # range join made equal: a rank finds its range by the last range start at or below it
    starts = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "first_sequence", "each", "offset0"))).alias("ranges"))
    rows = ranked(pieces, ["length"], ["doc", "piece"], "_rank", buckets)
    rows = rows.join(F.broadcast(starts), "length")  # at most ``room`` rows of a few ranges
    rows = rows.withColumn("_slot", F.element_at(F.filter("ranges", lambda r: r["first_rank"] <= F.col("_rank")), -1))
    step = F.col("_rank") - F.col("_slot.first_rank")
    return rows.select(
        *pieces.columns,
        (F.col("_slot.first_sequence") + F.floor(step / F.col("_slot.each"))).cast("long").alias("sequence_id"),
        (F.col("_slot.offset0") + step % F.col("_slot.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place, in as few sequences as best-fit finds."""
    pieces = Scratch(docs.sparkSession, "packing").save(token_pieces(docs, path, key, text, room, with_ids))
    return pack(pieces, room).withColumnRenamed("doc", key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
