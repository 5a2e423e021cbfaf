"""The corpus pipeline's stages against brute force, with null and repeated ids."""

from collections import Counter

import corpus_pipeline as pipeline
from newsquant.llm import simhash

BASE = [f"word{i}" for i in range(40)]
OTHER = [f"other{i}" for i in range(40)]
LINE = "one two three four five six seven"
ROWS = [
    (5, " ".join(BASE)), (5, " ".join(BASE)), (None, " ".join(BASE)), (7, " ".join([*BASE[:20], "x", *OTHER])), (7, " ".join([*OTHER[:25], "y", "z"])),
    (None, " ".join(["n", *OTHER[5:30], "m"])), (None, f"alone\n{LINE}"), (9, f"{LINE}\nnine"), (9, f"nine again\nand more\n{LINE}"), (2, None),
]


def run(spark, stage):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect())


def order(row):
    return (row[0] is None, row[0] or 0, row[1] is None, row[1] or "")


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = sorted(ROWS, key=order)
    prints = [simhash.fingerprint(t) & (2**64 - 1) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    assert run(spark, pipeline.near_dedup) == Counter(r for i, r in enumerate(rows) if label[i] == i)


def test_substring_dedup_cuts_each_row(spark):
    seen, want = set(), Counter()
    for doc, text in sorted(ROWS, key=order):
        w = (text or "").split()
        grams = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {p for j, g in enumerate(grams) if g in seen for p in range(j, j + 13)}
        seen.update(grams)
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else text
        want.update([(doc, text)] * bool(text))
    assert run(spark, pipeline.substring_dedup) == want


def test_line_dedup_cuts_each_row(spark):
    seen, want = set(), Counter()
    for doc, text in sorted(ROWS, key=order):
        lines = [] if text is None else text.split("\n")
        stay = [x for x in lines if not x.strip() or x not in seen]
        seen.update(lines)
        want[(doc, None if text is None else "\n".join(stay))] += 1
    assert run(spark, pipeline.line_dedup) == want
