"""Every registered corpus query on the smallest tables, and the whole pipeline, against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import _line_labels

import corpus_pipeline
from newsquant.llm import bpe, registry, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, sf=SF):
    return QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, db, name):
    found = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r[c] for c in columns) for r in rows(spark, name)]
    assert sorted(got) == sorted(found.fetchall())


def test_lattice_query(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    links = (x @ x.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    label = list(ids)
    for _ in ids:
        label = [min([label[i], *[label[j] for j in np.flatnonzero(links[i])]]) for i in range(len(ids))]
    want = [(i, int(links[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, "op2_lattice")) == want


def test_sharding_query(spark, texts):
    got = rows(spark, "op3_sharding")
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert {r["law"] for r in got} == {"key"} and all(0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) for r in got)
    for shard in range(40):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_bpe_query(spark, texts):
    vocab = pytest.importorskip("public_tokenizers")
    import tiktoken

    whole = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=bpe.read_ranks(vocab.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in texts.items():
        ids = whole.encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op4_bpe")} == want


def plain_line_dedup(texts):
    """Kept lines of each text and positions of the others, by all pairs of distinct lines."""
    found = {}
    for i, t in sorted(texts.items()):
        for no, line in enumerate(t.split("\n") if t is not None else []):
            if WORD.search(line):
                found.setdefault(line, (i, no))
    distinct = list(found)
    # lines of very different lengths cannot link, so all pairs are tried within lengths that can
    order = sorted(range(len(distinct)), key=lambda k: len(distinct[k]))
    label = list(range(len(distinct)))
    sets = [{s[i : i + 9] for i in range(max(1, len(s) - 8))} for s in distinct]
    links = []
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]) and len(sets[b]) > len(distinct[b]) * 0.9:
                if len(distinct[a]) < 0.5 * len(distinct[b]):
                    break
                continue
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    while True:
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    first = {}
    for k, line in enumerate(distinct):
        first[label[k]] = min(first.get(label[k], found[line]), found[line])
    keep = {line: first[label[k]] for k, line in enumerate(distinct)}
    gone = {i: [no for no, line in enumerate(t.split("\n")) if line in keep and keep[line] != (i, no)] if t is not None else [] for i, t in texts.items()}
    left = {i: None if t is None else "\n".join(line for no, line in enumerate(t.split("\n")) if no not in set(gone[i])) for i, t in texts.items()}
    return left, gone


def test_lines_query(spark, texts):
    _, gone = plain_line_dedup(texts)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], list(r["removed_lines"])) for r in rows(spark, "op6_lines")}
    assert got == {i: (0 if t is None else t.count("\n") + 1, len(gone[i]), gone[i]) for i, t in texts.items()}


def packed(got, texts):
    """Check the rows of a packing of ``texts``; returns the number of sequences and the least possible."""
    vocab = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    want, total = set(), 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        want |= {(i, k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))}
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)]).tolist()
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return len(held), math.ceil(total / 2048)


def test_packing_query(spark, texts):
    n, least = packed(rows(spark, "op7_packing"), texts)
    assert least <= n <= least * 1.01 + 1


def test_extraction_query(spark):
    got = rows(spark, "op8_extraction")
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def test_quality_classifier_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in rows(spark, "op9_quality_classifier", sf)}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    own = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"] and y is not None]
    good, bad = ([s for s, y in own if y == k] for k in (1, 0))
    better = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(own) > 50 and better > 0.95
    assert np.mean([(s >= 0.3) == y for s, y in own]) > 0.9


def plain_components(texts):
    ids = sorted(texts)
    prints = np.array([simhash.fingerprint(texts[i]) & (2**64 - 1) for i in ids], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        low = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (low == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = low


def test_simhash_query(spark, texts):
    got = rows(spark, "op10_simhash")
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(texts)
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in texts.items()}


def test_whole_pipeline(spark, db, texts):
    sql = registry.oracle_sql()["op1_quality"]
    kept = {r[0] for r in db.execute(f"select doc_id from ({sql}) where kept").fetchall()}
    left, _ = plain_line_dedup({i: t for i, t in texts.items() if i in kept})
    heads = plain_components(left)
    left = {i: t for i, t in left.items() if heads[i] == i}
    seen, out = set(), {}
    for i, t in sorted(left.items()):
        w = WORD.findall(t or "")
        grams = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {p for j, g in enumerate(grams) if g in seen for p in range(j, j + 13)}
        seen.update(grams)
        own = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        if own:
            out[i] = own
    assert 20 < len(out) < len(kept) < len(texts)
    n, least = packed(corpus_pipeline.run(spark, SF).collect(), out)
    assert least <= n <= least * 1.01 + 1


def test_pipeline_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_line_labels_agree():
    """The two restatements of line dedup say the same."""
    lines = ["one two three four five six seven", "one two three four five six seven!", "something else entirely", "one two three four five six"]
    labels = _line_labels(lines)
    left, _ = plain_line_dedup({i: t for i, t in enumerate(lines)})
    assert {i for i, t in left.items() if t} == {int(x) for x in labels}
