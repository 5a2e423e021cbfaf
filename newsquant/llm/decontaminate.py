"""Operator 12: benchmark decontamination by an FM-index per training shard.

Words are runs of letters, digits and all characters beyond ASCII, with A-Z lower-cased. The test
phrases are the windows of ``width`` consecutive words of every benchmark item (an item of fewer words
is one phrase). Spark cuts them, and deals them to blocks of bounded size; a block is broadcast and all
documents are searched for it.

A task cuts its documents into shards. In a shard words are symbols of the block's vocabulary; words that
no phrase holds, and ends of documents, are separators, each different from all others. The shard's
suffixes are sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet matrix, phrases
are found by backward search through its ranks, and occurrences are located by walking back to a sampled
suffix position. Spans of hit words are merged. Texts of any length are cut into overlapping shards,
so memory does not grow with them.

Null, empty and wordless texts have no words and no hits. A benchmark item without words is no phrase.
Repeated documents are searched one by one and get equal results; items with equal words are one class,
found once and named by all their ids. An item with a null id marks words but adds no name. Rows with a
null key are kept. Only key and text are read, so other columns' names never clash. An empty table of documents
gives an empty result, an empty benchmark no hits. Two different items whose words have equal 64-bit
hashes would count as one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pieces, plain_bytes, plain_words

#: Positions of a shard take so many bits of a sort key.
_AT = 20
#: Every so-manieth text position keeps its suffix's place.
_SAMPLE = 16


class WaveletMatrix:
    """Ranks and values of a sequence of symbols, one bit level after another."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((bit, ones, np.int32(len(bit) - ones[-1])))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.bits = bits

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix ``[0, at)`` of each symbol ends below the last level."""
        for k, (_, ones, zeros) in enumerate(self.levels):
            below = ones[at]
            at = np.where(symbols >> (self.bits - 1 - k) & 1, zeros + below, at - below)
        return at

    def value(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and where that place lies below the last level."""
        symbols = np.zeros(len(at), dtype=np.int32)
        for bit, ones, zeros in self.levels:
            one, below = bit[at], ones[at]
            at = np.where(one, zeros + below, at - below)
            symbols = symbols << 1 | one
        return symbols, at


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of ``text``, whose zeros are separators that sort by their place, all before other symbols.

    A first sort by the leading symbols up to a separator leaves apart only suffixes that agree on all of
    them; those are sorted by the ranks of what follows, over twice the length each time.
    """
    n = len(text)
    lead = max(1, (62 - _AT) // bits)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(lead):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(n - k, 0)] = text[k:]
        alive &= ahead > 0
        key = key << bits | np.where(alive, ahead, 0)
    place = np.sort(key << _AT | np.arange(n))
    order = place & ((1 << _AT) - 1)
    place >>= _AT
    # a suffix is settled when its key is alone or ends at a separator, as ties are then in order
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = (place[1:] != place[:-1]) | ~alive[order[1:]]
    rank = np.empty(n, dtype=np.int64)
    first = np.flatnonzero(new[:n])
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    open_ = np.flatnonzero(~(new[:n] & new[1:]))
    while len(open_):
        at = order[open_]
        group = rank[at]
        place = np.sort((group << _AT | rank[at + lead]) << _AT | at)
        at = place & ((1 << _AT) - 1)
        order[open_] = at
        place >>= _AT
        new = np.ones(len(at) + 1, dtype=bool)
        new[1:-1] = place[1:] != place[:-1]
        first = np.flatnonzero(new[:-1])
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(at))))
        open_ = open_[~(new[:-1] & new[1:])]
        lead *= 2
    return order


class FMIndex:
    """Counts and places of phrases in ``text``, symbols from 1 with zeros as separators, one first and one last."""

    def __init__(self, text: np.ndarray, bits: int):
        order = suffix_order(text, bits)
        before = text[order - 1]
        self.wavelet = WaveletMatrix(before, bits)
        counts = np.bincount(text, minlength=1 << bits)
        self.starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.bottoms = self.wavelet.down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))
        # a suffix after a separator is always sampled, as separators have no order to step back by
        self.sampled = (before == 0) | (order % _SAMPLE == 0)
        self.before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]
        self.n = len(text)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of each phrase, a row of ``phrases`` filled from the left, by backward search."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1]):
            rows = np.flatnonzero((lengths > k) & (low < high))
            symbols = phrases[rows, lengths[rows] - 1 - k]
            shift = self.starts[symbols] - self.bottoms[symbols]
            low[rows] = self.wavelet.down(symbols, low[rows]) + shift
            high[rows] = self.wavelet.down(symbols, high[rows]) + shift
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to the nearest sampled suffix."""
        at, steps, open_ = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(open_ := open_[~self.sampled[at[open_]]]):
            symbols, down = self.wavelet.value(at[open_])
            at[open_] = self.starts[symbols] + down - self.bottoms[symbols]
            steps[open_] += 1
        return self.samples[self.before[at]] + steps


class Phrases:
    """A block of test phrases as symbols, and the classes of items that each belongs to."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        found: dict[tuple[bytes, ...], list[int]] = {}
        for words, item in rows:
            found.setdefault(tuple(w.encode() for w in words), []).append(item)
        self.symbols = {w: i for i, w in enumerate(sorted({w for p in found for w in p}), 1)}
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.table = np.zeros((len(found), max(self.lengths, default=1)), dtype=np.int32)
        for row, phrase in zip(self.table, found):
            row[: len(phrase)] = [self.symbols[w] for w in phrase]
        self.ends = np.cumsum([len(c) for c in found.values()])
        self.classes = np.array([c for cs in found.values() for c in cs], dtype=np.int64)
        self.bits = max(1, len(self.symbols).bit_length())

    def encode(self, text: str | None) -> np.ndarray:
        """Symbol of each word of a text, 0 for words of no phrase."""
        out = [np.zeros(0, dtype=np.int32)]
        for piece in pieces(plain_bytes(text)):
            words = piece.split()
            out.append(np.fromiter(map(self.symbols.get, words, repeat(0)), np.int32, len(words)))
        return np.concatenate(out)


def _shards(lengths: np.ndarray, width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of ``(document, first word, end)`` whose words, with ends, fit one shard; cuts overlap by a phrase."""
    room, shard = (1 << _AT) - 2, []
    for doc, n in enumerate(lengths):
        at = 0
        while at < n:
            if room < min(n - at, 4 * width) + 1:
                yield shard
                room, shard = (1 << _AT) - 2, []
            end = min(n, at + room - 1)
            shard.append((doc, at, end))
            room -= end - at + 1
            at = end if end == n else end - width + 1
    if shard:
        yield shard


def search(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, its merged spans ``[start, end)`` of hit words, and the classes that hit it."""
    coded = [phrases.encode(t) for t in texts]
    lengths = np.array([len(c) for c in coded], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    # where spans begin less where they end; a slot more for each text, as a span may end at its end
    change = np.zeros(first[-1] + len(texts) + 1, dtype=np.int64)
    pairs: list[np.ndarray] = []
    width = phrases.table.shape[1]
    for shard in _shards(lengths, width) if len(phrases.lengths) else ():
        symbols = np.concatenate([np.zeros(1, dtype=np.int32)] + [np.append(coded[d][a:b], 0) for d, a, b in shard])
        places = np.concatenate([np.zeros(1, dtype=np.int64)] + [np.arange(a, b + 1) + first[d] + d for d, a, b in shard])
        docs = np.concatenate([np.zeros(1, dtype=np.int64)] + [np.full(b - a + 1, d) for d, a, b in shard])
        # neighbouring separators are one
        stay = np.append(True, (symbols[1:] > 0) | (symbols[:-1] > 0))
        symbols, places, docs = symbols[stay], places[stay], docs[stay]
        if symbols[-1]:
            raise AssertionError("a shard ends at a separator")
        index = FMIndex(symbols, phrases.bits)
        low, high = index.ranges(phrases.table, phrases.lengths)
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at = index.locate(rows)
        np.add.at(change, places[at], 1)
        np.add.at(change, places[at] + phrases.lengths[which], -1)
        pairs.append(np.unique(docs[at] * len(counts) + which))
    depth = np.cumsum(change)
    spans = []
    for d, n in enumerate(lengths):
        hit = np.concatenate(([0], depth[first[d] + d : first[d] + d + n] > 0, [0]))
        spans.append(np.flatnonzero(np.diff(hit)).reshape(-1, 2))
    classes: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    if pairs and len(found := np.unique(np.concatenate(pairs))):
        doc, phrase = np.divmod(found, len(phrases.lengths))
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for d, own in zip(doc[np.append(0, cuts)], np.split(phrase, cuts)):
            starts = np.where(own > 0, phrases.ends[own - 1], 0)
            classes[d] = np.unique(np.concatenate([phrases.classes[a:b] for a, b in zip(starts, phrases.ends[own])]))
    return lengths, spans, classes


def test_phrases(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(class, words)``, one row for each class of items and phrase of it, and ``(class, items)``, sorted ids as strings."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), plain_words(text).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item", "words", F.xxhash64(F.array_join("words", " ")).alias("class"))
    items = rows.groupBy("class").agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("words").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    cut = items.select("class", "words", F.explode(starts).alias("at")).select("class", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
    return cut.distinct(), items.select("class", "items")


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    kind = "array<struct<start:int,end:int>>"
    joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), joined(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.array().cast(kind), step)


def hit_spans(docs: DataFrame, phrases: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", block_rows: int = 100_000, block_bytes: int = 16 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """``(key, n_words, spans, classes)`` of every row of ``docs``.

    ``spans`` are the merged ``[start, end)`` of words that a phrase of ``phrases(class, words)`` covers and
    ``classes`` (sorted) those of the phrases found. A broadcast holds at most about ``block_rows`` phrases and
    ``block_bytes`` of words; more phrases take more passes over the documents. A task searches
    ``shard_bytes`` of text at a time.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    phrases = scratch.save(phrases)
    total, size = phrases.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("words", " ")) * 4), F.lit(0))).first()
    blocks = max(1, -(-total * 5 // (4 * block_rows)), -(-size * 5 // (4 * block_bytes)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if blocks > 1:
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in rows.columns if c != "text"])
    span = T.StructType().add("start", "integer").add("end", "integer")
    schema = schema.add("n_words", "long").add("spans", T.ArrayType(span)).add("classes", T.ArrayType(T.LongType()))
    parts = []
    for block in range(blocks):
        own = phrases.where(F.pmod(F.xxhash64("class", "words"), F.lit(blocks)) == block).select("words", "class")
        sent = spark.sparkContext.broadcast(Phrases([(list(r["words"]), r["class"]) for r in own.collect()]))

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sizes = batch["text"].map(lambda t: len(t) if t else 0).to_numpy()
                for _, part in batch.groupby((np.cumsum(sizes) - sizes) // shard_bytes, sort=False):
                    n_words, spans, classes = search(part["text"].tolist(), sent.value)
                    out = part.drop(columns="text").assign(n_words=n_words)
                    out["spans"] = [[{"start": a, "end": b} for a, b in s.tolist()] for s in spans]
                    yield out.assign(classes=classes)

        parts.append(rows.mapInPandas(find, schema))
    if blocks == 1:
        out = parts[0]
    else:
        out = scratch.save(parts[0])
        for part in parts[1:]:
            out = out.unionByName(scratch.save(part))
        flat = lambda c: F.flatten(F.collect_list(c))
        out = out.groupBy("row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), _merged(flat("spans")).alias("spans"), F.sort_array(F.array_distinct(flat("classes"))).alias("classes"))
    return out.select(F.col("key").cast(kind).alias(key), "n_words", "spans", "classes")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, **how) -> DataFrame:
    """``(key, n_words, spans, items)``: spans of words to remove and the sorted ids (strings) of items found, for every row.

    ``how`` goes to :func:`hit_spans`.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    phrases, classes = test_phrases(benchmark, item, item_text, width)
    found = scratch.save(hit_spans(docs, phrases, scratch, key, text, **how))
    # ids are gathered once for each set of classes, however many documents share it
    sets = found.where(F.size("classes") > 0).select("classes").distinct()
    named = sets.select("classes", F.explode("classes").alias("class")).join(classes, "class")
    named = named.groupBy("classes").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    clean = found.where(F.size("classes") == 0).withColumn("items", F.array().cast("array<string>"))
    hit = found.where(F.size("classes") > 0).join(named, "classes")
    return clean.select(key, "n_words", "spans", "items").unionByName(hit.select(key, "n_words", "spans", "items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
