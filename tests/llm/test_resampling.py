"""Operator 11 against a plain restatement of its definition."""

import hashlib
import math
import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from newsquant.llm import resampling

TESTDATA = "/root/testdata"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=5, min_words=20):
    raw, aim = Counter(), Counter()
    own = [(key, *features(text)) for key, text in docs]
    for _, _, found in own:
        raw.update(found)
    for text in target:
        aim.update(features(text)[1])
    n_raw, n_aim = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (n_raw + 10000) / ((raw[b] + 1.0) * (n_aim + 10000))))
    rows = []
    for key, n, found in own:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(*r, i) for i, r in enumerate(able[: percent * len(able) // 100], 1)]
    rest = able[len(drawn) :] + [r for r in rows if r[1] < min_words]
    return sorted(map(str, drawn + [(*r, None) for r in rest]))


def rows_of(out):
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("chunk", [64, 4 << 20])
def test_payloads_compose_to_every_feature(chunk):
    long, longer = "y" * 65, "z" * 300
    texts = ["One two  three", None, "", "--", "é 日本 É", f"a {long} b {longer} c {longer}", "x" * 64 + " b", "w " * 500, long, "a\x00b\x7fc`d{e"]
    n_words, found = resampling.feature_buckets(texts, 10000, chunk)
    for text, n, blob in zip(texts, n_words, found):
        assert (int(n), sorted(np.frombuffer(blob, "<u2").tolist())) == (features(text)[0], sorted(features(text)[1]))


def test_query_against_brute_force(spark):
    sf = f"{TESTDATA}/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    out = resampling.op11_importance_resampling(spark, sf)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(t == "bigint" for _, t in out.dtypes)
    assert rows_of(out) == sorted(str(eval(r)[:1] + eval(r)[2:]) for r in plain(docs, target))


def test_nulls_ties_repeats_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(1, text), (1, text), (None, text), (None, text), (2, None), (3, ""), (4, "one two"), (5, text.upper())] + [(i, text) for i in range(10, 40)]
    df = spark.createDataFrame([(k, t, "n", 0, b"b") for k, t in docs], "doc_id long, text string, n_words string, score int, buckets binary")
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    out = resampling.resample(df, target, percent=50)
    assert rows_of(out) == plain(docs, ["w1 w2 w3", None], 50)
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 17


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(7, "a b " * 20)], "doc_id long, text string")
    assert rows_of(resampling.resample(one, none, percent=100)) == plain([(7, "a b " * 20)], [], 100)


def test_weight_draws_towards_the_target(spark):
    near, far = "alpha beta gamma " * 10, "delta epsilon zeta " * 10
    docs = spark.createDataFrame([(i, near if i % 4 == 0 else far) for i in range(200)], "doc_id long, text string")
    out = resampling.resample(docs, spark.createDataFrame([(near,)], "text string"), percent=20)
    drawn = [r["doc_id"] for r in out.where("rank is not null").collect()]
    assert len(drawn) == 40 and all(d % 4 == 0 for d in drawn)


