"""Operator 12 against a plain search of every phrase in every text."""

import hashlib
import random
import re
import string

import numpy as np
import pytest

from newsquant.llm import decontaminate

TESTDATA = "/root/testdata"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, width=10):
    """``(key, n_words, spans, items)`` by looking every window of every document up."""
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1)) if words else ():
            windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    sizes, rows = {len(w) for w in windows}, []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                window = tuple(words[i : i + size])
                if window in windows:
                    hit.update(range(i, i + size))
                    found |= windows[window]
        edges = [i for i in hit if i - 1 not in hit], [i + 1 for i in hit if i + 1 not in hit]
        rows.append((key, len(words), list(zip(sorted(edges[0]), sorted(edges[1]))), sorted(str(f) for f in found if f is not None)))
    return sorted(map(str, rows))


def rows_of(out):
    return sorted(str((r[0], r["n_words"], [tuple(s) for s in r["spans"]], list(r["items"]))) for r in out.collect())


def test_suffix_order_and_index(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(150):
        top = int(rng.choice([1, 2, 5, 900]))
        text = np.concatenate(([0], rng.integers(0, top + 1, rng.integers(1, 90)), [0])).astype(np.int32)
        if trial % 3 == 0:  # long repeats
            text = np.concatenate((text[text > 0], [0], text[text > 0], text)).astype(np.int32)
            text = np.concatenate(([0], text)).astype(np.int32)
        bits = top.bit_length() if trial % 2 else 20

        def suffix(i):
            end = i + int(np.flatnonzero(text[i:] == 0)[0])
            return [(1, int(s)) for s in text[i:end]] + [(0, end)]

        order = decontaminate.suffix_order(text, bits)
        assert order.tolist() == sorted(range(len(text)), key=suffix)
        if bits == 20:
            continue
        index = decontaminate.FMIndex(text, bits)
        phrases = rng.integers(1, top + 1, (6, 3)).astype(np.int32)
        lengths = rng.integers(1, 4, 6)
        low, high = index.ranges(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("bits", [6, 20])
def test_shards_and_long_texts(monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "_AT", bits)
    for trial in range(30):
        r = random.Random(trial)
        own = ["a", "b", "é", "x1"][: r.randint(1, 4)]
        texts = [None if r.random() < 0.1 else " ".join(r.choice([*own, "zz"]) for _ in range(r.randint(0, 300))) for _ in range(r.randint(0, 6))]
        phrases = [([r.choice(own) for _ in range(r.choice([10, 10, 1, 2, 3]))], r.randint(1, 9)) for _ in range(r.randint(0, 9))]
        n_words, spans, classes = decontaminate.search(texts, decontaminate.Phrases(phrases))
        for text, n, own_spans, found in zip(texts, n_words, spans, classes):
            words, hit, want = words_of(text), set(), set()
            for phrase, item in phrases:
                for i in range(len(words) - len(phrase) + 1):
                    if words[i : i + len(phrase)] == phrase:
                        hit.update(range(i, i + len(phrase)))
                        want.add(item)
            assert int(n) == len(words) and found.tolist() == sorted(want)
            assert {i for a, b in own_spans for i in range(a, b)} == hit


def test_query_against_brute_force(spark):
    sf = f"{TESTDATA}/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = []
    for row in plain(docs, items):
        key, n, spans, found = eval(row)
        hit = sum(b - a for a, b in spans)
        want.append((key, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sum(w[5] for w in want) > 3
    assert sorted(tuple(r) for r in decontaminate.op12_decontamination(spark, sf).collect()) == sorted(want)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"x {PASSAGE} y"), (1, f"x {PASSAGE} y"), (None, PASSAGE.upper()), (2, None), (3, ""), (4, "..."), (5, "one two three four five six seven eight nine"), (6, "Foo, bar! foo bar foo"), (7, "clean words " * 40), (8, f"{PASSAGE} mid {PASSAGE} foo bar")]
ITEMS = [(10, PASSAGE), (9, PASSAGE), (9, "foo bar"), (11, None), (12, ""), (13, "foo bar"), (None, "clean words"), (14, "eleven twelve")]


@pytest.mark.parametrize("block_rows", [1, 100_000])
def test_nulls_repeats_blocks_and_clashing_names(spark, block_rows):
    docs = spark.createDataFrame([(k, t, "n", 0, 1) for k, t in DOCS], "doc_id long, text string, n_words string, row int, classes int")
    items = spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, words int")
    assert rows_of(decontaminate.decontaminate(docs, items, block_rows=block_rows)) == plain(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontaminate.decontaminate(docs, items)) == plain(DOCS, [])
    assert decontaminate.decontaminate(none, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
