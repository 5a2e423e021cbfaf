"""Operator 4: byte-level BPE with each distinct word encoded once for the whole corpus.

Documents are cut into pre-tokens in blocks of about ``block_bytes`` of text. A block keeps its
documents as positions in the block's list of distinct words, in a table dealt by block, so that
positions never shuffle. The block's words leave by a hash of the word, packed: one row for each
block and share of the words. Rows of a share meet, each distinct word is encoded once, the ids go
back to the blocks' places, the token-byte table decodes them, and documents are reassembled by
position.

A null text is empty. A text longer than a block is a block of its own. Very long words are one
word. Repeated rows and ties give equal results. Other columns are left out, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_BLOCKS = "block long, doc long, places binary, share int, words binary"


def _planes(values: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).astype(np.uint32)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


def _pack_lists(lists: list[bytes]) -> bytes:
    """Byte strings as one compressed string: how many, their sizes, their bytes."""
    sizes = np.array([len(lists), *map(len, lists)], dtype="<u4").tobytes()
    return zlib.compress(sizes + b"".join(lists), 6)


def _unpack_lists(raw: bytes) -> list[bytes]:
    raw = zlib.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4)) + 4 * n + 4).tolist()
    return [raw[a:b] for a, b in zip([4 * n + 4, *ends], ends)]


def _cut_blocks(pattern: str, block_bytes: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from xxhash import xxh32_intdigest

        cut = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        place: dict[str, int] = {}
        docs, packed, used = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            """The block's documents, then a row for each share of its words."""
            words = [w.encode("utf-8", "surrogatepass") for w in place]
            of = np.array([xxh32_intdigest(w) % shares for w in words], dtype=np.int32)
            own = [np.flatnonzero(of == s).tolist() for s in np.unique(of).tolist()]
            for places in own:
                places.sort(key=words.__getitem__)  # neighbours share beginnings
            n, m = len(docs), len(own)
            columns = [
                pa.array(np.full(n + m, number, dtype=np.int64)),
                pa.array(docs + [None] * m, pa.int64()),
                pa.array(packed + [zlib.compress(_planes(np.array(p))) for p in own], pa.binary()),
                pa.array([None] * n + np.unique(of).tolist(), pa.int32()),
                pa.array([None] * n + [_pack_lists([words[i] for i in p]) for p in own], pa.binary()),
            ]
            whole = pa.RecordBatch.from_arrays(columns, ["block", "doc", "places", "share", "words"])
            for at in range(0, n + m, 10_000):
                yield whole.slice(at, 10_000)

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                own = text.as_py() or ""
                docs.append(doc)
                packed.append(_planes(np.array([place.setdefault(w, len(place)) for w in cut(own)], dtype=np.uint32)))
                used += len(own)
                if used >= block_bytes:
                    yield from out()
                    number, place, docs, packed, used = number + 1, {}, [], [], 0
        if docs:
            yield from out()

    return run


def _encode(path: str, most: int = 1_000_000):
    """Ids of each row's words, four bytes an id; a share's words are remembered, ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for raw in batch.column("words").to_pylist():
                words = _unpack_lists(raw)
                if len(known) > most:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w.decode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
                out.append(_pack_lists([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("places"), pa.array(out, pa.binary())], ["block", "places", "ids"])

    return run


def _reassemble(path: str, digest: bool):
    def run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        token_bytes = {rank: token for token, rank in read_ranks(path).items()}
        texts: dict[int, str] = {}
        decoded: dict[int, bytes] = {}
        sizes: dict[int, int] = {}
        for where, raw in zip(codes.column("places").to_pylist(), codes.column("ids").to_pylist()):
            for at, own in zip(_unpack(zlib.decompress(where)).tolist(), _unpack_lists(raw)):
                ids = np.frombuffer(own, dtype="<u4").tolist()
                texts[at], decoded[at], sizes[at] = " ".join(map(str, ids)), b"".join([token_bytes[i] for i in ids]), len(ids)
        n_tokens, first, second = [], [], []
        for raw in docs.column("places").to_pylist():
            at = _unpack(raw).tolist()
            n_tokens.append(sum(map(sizes.__getitem__, at)))
            text, back = " ".join(map(texts.__getitem__, at)), b"".join(map(decoded.__getitem__, at))
            first.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            second.append(hashlib.sha256(back).hexdigest() if digest else back)
        kind = pa.string() if digest else pa.binary()
        return pa.table({"doc": docs.column("doc"), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(first, pa.string()), "decoded": pa.array(second, kind)})

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", digest: bool = False, block_bytes: int = 24_000_000) -> DataFrame:
    """``(key, n_tokens, ids, decoded)``: ids joined by spaces and the bytes they decode to.

    ``digest`` replaces both by their SHA-256 in lowercase hex.
    """
    scratch = Scratch(docs.sparkSession, "bpe")
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    blocks = scratch.save_bucketed(rows.mapInArrow(_cut_blocks(pattern, block_bytes, shares), _BLOCKS), "block")
    words = blocks.where("share is not null").select("block", "share", "places", "words").repartition(shares, "share")
    codes = words.mapInArrow(_encode(path), "block long, places binary, ids binary")
    held = blocks.where("share is null").select("block", "doc", "places")
    kind = "string" if digest else "binary"
    out = held.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_reassemble(path, digest), f"doc long, n_tokens long, ids string, decoded {kind}")
    return out.withColumnRenamed("doc", key)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
