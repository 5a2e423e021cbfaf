"""Queries and operators on rows and groups that the small tables lack."""

import re
from collections import Counter
from hashlib import md5
from itertools import product
from math import log1p

from pyspark.sql import functions as F

from newsquant import registry
from newsquant.functions.words import STOP_WORDS
from newsquant.operators import mentions, text, topics, vectors
from newsquant.plans import articles, signals


def test_keywords_of_a_text_cut_inside_a_word(spark, tmp_path):
    said = "filler " * 7142 + " trafalgar"  # the cut leaves of the last word what is no word elsewhere
    assert "trafa" not in STOP_WORDS and said[:50_000].endswith(" trafa")
    spark.createDataFrame([(1, said, "en"), (2, "gardens", "en")], "doc_id long, text string, lang string").selectExpr("*", "'x' as source").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["article_id"]: r["keywords"] for r in registry.queries()["T2_lexicon_keywords"](spark, str(tmp_path)).collect()}
    assert rows[1].split(" ") == ["filler"] * 7142 + ["trafa"]


def test_phrases_of_common_words_meet_only_as_neighbours(spark, monkeypatch):
    kept = {}
    saved = mentions.files.saved

    def counted(df, name="kept"):
        kept[name] = saved(df, name)
        return kept[name]

    monkeypatch.setattr(mentions.files, "saved", counted)
    bodies = [(i, "re x " * 50 + "wh x " * 50 + ("re wh wh re wh" if i == 7 else "")) for i in range(20)]
    phrases = spark.createDataFrame([("A", "re wh", False), ("B", "wh re wh", False)], "ticker string, phrase string, tight boolean")
    hits = mentions.phrase_hits(mentions.saved_index(spark.createDataFrame(bodies, "article_id long, body string"), phrases), phrases).collect()
    assert sorted((h["article_id"], h["phrase"], h["start"]) for h in hits) == [(7, "re wh", 501), (7, "re wh", 510), (7, "wh re wh", 507)]
    assert kept["words"].count() == 2005 and kept["pairs"].count() == 3


def test_terms_are_dealt_before_they_are_counted(spark, monkeypatch):
    plans = {}
    saved = topics.files.saved

    def kept(df, name="kept"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return saved(df, name)

    monkeypatch.setattr(topics.files, "saved", kept)
    rows = spark.createDataFrame([(0, "alpha beta gamma alpha"), (1, "beta beta")], "topic_id int, fulltext string")
    found = {(r["topic_id"], r["rank"]): r["term"] for r in topics.topic_terms(rows).collect()}
    assert found[1, 1] == "beta" and len(found) == 10
    assert plans["terms"].rindex("HashAggregate") < plans["terms"].index("Exchange hashpartitioning(topic_id")


def test_similar_vectors_travel_as_narrow_as_they_are(spark, monkeypatch):
    kinds = []
    signed = vectors.signed_vectors
    monkeypatch.setattr(vectors, "signed_vectors", lambda rows, *a: kinds.append(rows.schema["vec"].dataType.simpleString()) or signed(rows, *a))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "article_id long, vec array<float>")
    assert sorted(r["article_id"] for r in vectors.drop_similar(rows).collect()) == [1, 3] and kinds == ["array<float>"]


def test_texts_are_hashed_once_and_vectors_made_for_members_only(spark, monkeypatch):
    made = {}
    saved, hashed = signals.files.saved, vectors.hashed_vectors
    monkeypatch.setattr(signals.files, "saved", lambda df, name="kept": made.setdefault(name, saved(df, name)))
    monkeypatch.setattr(vectors, "hashed_vectors", lambda counts, weights, key: made.setdefault(key, hashed(counts, weights, key)))
    sf = "/root/testdata/sf0.01"
    registry.queries()["J1_text_similarity"](spark, sf).collect()
    members = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert made["slots"].columns == ["article_id", "slot", "n"]
    known = {r["article_id"] for r in made["slots"].select("article_id").distinct().collect()}
    assert known - members and {r["article_id"] for r in made["article_id"].collect()} == known & members


def test_words_are_cut_and_hashed_as_before(spark):
    said = "Alpha--beta  ab GAMMA1deltaKépsilon\nhttp://x.y/z alpha,,beta"
    want = ["alpha", "beta", "gamma", "delta", "psilon", "alpha", "beta"]
    row = spark.createDataFrame([(1, said), (2, None), (3, "")], "k int, t string")
    assert row.select(text.clean_tokens(F.col("t")).alias("w")).orderBy("k").first()["w"] == want
    terms = want + [f"{a} {b}" for a, b in zip(want, want[1:])]
    for dims in (2, 64, 100, 256, 1000):
        found = {r["slot"]: r["n"] for r in vectors.hashed_counts(row, "k", "t", dims).collect()}
        assert found == Counter(int(md5(t.encode()).hexdigest()[:8], 16) % dims for t in terms)
    counts = spark.createDataFrame([("a", 3, 2), ("a", 99, 1), ("b", 5, 1)], "k string, slot int, n long")
    weights = spark.createDataFrame([(3, 1.5), (99, 4.0), (5, 0.0)], "slot int, idf double")
    vecs = {r["k"]: r["vec"] for r in vectors.hashed_vectors(counts, weights, "k", 100).collect()}
    assert vecs["b"] == [0.0] * 100 and [(i, x) for i, x in enumerate(vecs["a"]) if x] == [(3, 0.6), (99, 0.8)]


def test_vocabulary_is_counted_once(spark):
    for name in ("M4_term_metrics", "M6_filter_terms"):
        assert not any("documents.parquet" in f for f in registry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_terms_are_scored_where_they_lie(spark, monkeypatch):
    made = {}
    saved = topics.files.saved
    monkeypatch.setattr(topics.files, "saved", lambda df, name="kept": made.setdefault(name, saved(df, name)))
    rows = spark.createDataFrame([(0, "alpha beta gamma alpha"), (1, "beta beta"), (-1, "beta")], "topic_id int, fulltext string")
    best = topics.topic_terms(rows, n=1)
    assert {(r["topic_id"], r["term"]): r["f"] for r in made["terms"].where("not contains(term, ' ')").collect()} == {(0, "alpha"): 2, (0, "beta"): 3, (0, "gamma"): 1, (1, "beta"): 3}
    assert "Exchange hashpartitioning(term" not in best._jdf.queryExecution().executedPlan().toString()
    assert {(r["topic_id"], r["term"]) for r in best.collect()} == {(0, "alpha"), (1, "beta")}


def test_texts_with_topics_are_dealt_to_all_tasks(spark, monkeypatch):
    plans = []
    saved = topics.files.saved
    monkeypatch.setattr(topics.files, "saved", lambda df, name="kept": plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    topics.topic_terms(spark.createDataFrame([(0, "alpha beta")], "topic_id int, fulltext string").coalesce(1)).collect()
    assert "RoundRobinPartitioning(4)" in plans[0]


def test_terms_are_dealt_into_parts_of_bounded_text_and_only_few_are_sorted(spark, monkeypatch):
    plans = []
    saved = topics.files.saved
    monkeypatch.setattr(topics, "PART_CHARS", 100)
    monkeypatch.setattr(topics.files, "saved", lambda df, name="kept": plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    names = ["z" + "".join(p) for p in product("abc", repeat=3)]
    texts = [(i % 3, " ".join(names[(i * i * j + j) % (5 + i)] for j in range(20))) for i in range(20)] + [(3, "xaaz xabz xacz"), (3, "xabz xaaz"), (4, "xaaz"), (5, ""), (6, None), (-1, "xaaz xaaz")]
    rows = spark.createDataFrame(texts, "topic_id int, fulltext string")
    best = topics.topic_terms(rows, n=4)
    parts = -(-sum(len(t or "") for k, t in texts if k >= 0) // 100)
    assert parts > 4 and [*map(int, re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plans[0]))] == [parts, parts]
    assert any("least" in line for line in best._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line)
    tf = Counter()
    for k, t in texts:
        words = (t or "").split()
        tf.update((k, " ".join(words[i : i + size])) for size in (1, 2, 3) for i in range(len(words) - size + 1) if k >= 0)
    own, whole = Counter(), Counter()
    for (k, term), n in tf.items():
        own[k] += n
        whole[term] += n
    mean = sum(own.values()) / len(own)
    want = [sorted((-round(n / own[k] * log1p(mean / whole[term]), 9), term) for (j, term), n in tf.items() if j == k)[:4] for k in sorted(own)]
    found = best.orderBy("topic_id", "rank").collect()
    assert [(r["topic_id"], r["rank"], r["term"]) for r in found] == [(k, i, t) for k, w in zip(sorted(own), want) for i, (_, t) in enumerate(w, 1)]
    assert all(abs(r["weight"] + w) < 2e-9 for r, (w, _) in zip(found, (x for w in want for x in w)))


def test_companies_of_texts_of_few_words(spark, tmp_path):
    texts = ["a b c", " 1a b2c--d ", "a b c d", "a b c d e f g", "9 a b c ", "", None, "éa b c d", "Abc def GHI jkl mno!"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1, len(texts) + 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = articles._raw_companies(spark, str(tmp_path))
    assert {(r["Ticker"], r["n"], r["Keywords"]) for r in rows.collect()} == {("B", 2, "a, b"), ("DEF", 9, "abc, def")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z]+, 6" in plan


def late_term(spark, path):
    """One company, a tenth alike to the one topic, whose term stands behind the first 400 characters of its text."""
    texts = [(1, "alpha beta gamma delta " + "ab " * 300 + "zebrafish"), (2, "zebrafish")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang", "'x' as source").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(1, -1, [0.1, 0.995]), (2, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_keywords_are_searched_in_whole_texts(spark, tmp_path):
    rows = registry.queries()["J2_keyword_score"](spark, late_term(spark, tmp_path))
    assert [tuple(r) for r in rows.collect()] == [(0, "BETA", 1.0)]


def test_the_gate_takes_keywords_of_whole_texts(spark, tmp_path):
    rows = registry.queries()["J3_stage1_gate"](spark, late_term(spark, tmp_path))
    assert [(r["topic_id"], r["ticker"]) for r in rows.collect()] == [(0, "BETA")]


def test_depths_take_keywords_of_whole_texts(spark, tmp_path):
    rows = registry.queries()["J15_depth_profiles"](spark, late_term(spark, tmp_path))
    assert sorted((r["depth"], r["pairs"], r["companies"]) for r in rows.collect()) == [(k, 1, 1) for k in (1, 2, 3, 4)]
