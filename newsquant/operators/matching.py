"""Topic x company matching: similarity, keyword, entailment and mention signals, gates, ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.words import FUND_MARKS
from ..sources import files


@dataclass(frozen=True)
class DepthProfile:
    """Gates of one search depth."""

    min_keyword: float
    min_similarity: float
    early_exit: bool
    hypotheses: int
    key_chars: int
    stricter: float = 0.0

    @staticmethod
    def of(depth: int) -> "DepthProfile":
        fast = depth in (1, 3)
        gate = 0.05 if fast else 0.03
        return DepthProfile(gate, gate, fast, 4 if fast else 6, 200 if depth <= 2 else 300, 0.02 if depth == 4 else 0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similarity_join(companies: DataFrame, centroids: DataFrame, least: float) -> DataFrame:
    """Every (topic, company) whose vectors' dot product reaches ``least``.

    Topics are few by construction (a clustering's classes): Spark broadcasts the smaller side of the
    nested-loop join if it is small enough, and companies never shuffle then.
    """
    pairs = companies.join(centroids, F.lit(True))
    return pairs.withColumn("sim", dot(F.col("vec"), F.col("centroid"))).where(F.col("sim") >= least).drop("vec", "centroid")


def share_contained(terms: str, text: Column) -> Column:
    """Share of ``terms`` that occur in ``text``; 0 without terms."""
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, hits / F.size(terms)).otherwise(0.0)


def stage1_gate(df: DataFrame, profile: DepthProfile) -> DataFrame:
    return df.where((F.col("kw") >= profile.min_keyword) | (F.col("sim") >= 0.15))


def hypotheses(terms: DataFrame, n: int) -> DataFrame:
    """Two sentences for each of a topic's first ``n`` terms."""
    said = F.array(*[F.concat(F.lit(f"This company {verb} "), "term", F.lit(".")) for verb in ("works with", "specializes in")])
    return terms.where(F.col("rank") <= n).select("topic_id", F.explode(said).alias("hypothesis"))


def entailment(pairs: DataFrame, said: DataFrame, logits: DataFrame) -> DataFrame:
    """Add ``nli``: the highest sigmoid of the logits of a pair's hypotheses; 0 where none is known."""
    asked = pairs.select("topic_id", "ticker", "desc_md5").join(said, "topic_id").join(logits, ["desc_md5", "hypothesis"])
    best = asked.groupBy("topic_id", "ticker").agg(F.max(1 / (1 + F.exp(-F.col("logit")))).alias("nli"))
    return pairs.join(best, ["topic_id", "ticker"], "left").withColumn("nli", F.coalesce("nli", F.lit(0.0)))


def missing_pairs(pairs: DataFrame, said: DataFrame, logits: DataFrame) -> DataFrame:
    """Distinct (text key, hypothesis) that have no logit yet, for a scorer to fill."""
    asked = pairs.select("topic_id", "desc_md5").join(said, "topic_id").select("desc_md5", "hypothesis").distinct()
    return asked.join(logits, ["desc_md5", "hypothesis"], "left_anti")


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    """``(part, desc_md5, hypothesis, logit)`` of a cache; a pair scored twice has its largest logit."""
    try:
        rows = spark.read.schema("desc_md5 string, hypothesis string, logit double, part string").parquet(path)
    except AnalysisException:  # no run has written yet
        rows = spark.createDataFrame([], "desc_md5 string, hypothesis string, logit double, part string")
    return rows.groupBy("part", "desc_md5", "hypothesis").agg(F.max("logit").alias("logit"))


def fill_logits(spark: SparkSession, path: str, asked: DataFrame, score: Callable[[pd.DataFrame], pd.Series], digits: int = 2) -> int:
    """Score the pairs of ``asked(desc_md5, hypothesis, ...)`` that the cache at ``path`` lacks, and append them; returns how many.

    ``score`` takes batches of all columns of ``asked`` and gives a logit for each row. The cache is
    dealt into folders by the key's first ``digits``, so that a lookup reads those of its keys only; a cache
    always has the same number of them.
    """
    part = F.substring("desc_md5", 1, digits)
    rows = asked.where("desc_md5 is not null and hypothesis is not null").dropDuplicates(["desc_md5", "hypothesis"]).withColumn("part", part)
    missing = rows.join(read_logits(spark, path), ["part", "desc_md5", "hypothesis"], "left_anti").select(*asked.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["desc_md5", "hypothesis"]].assign(logit=score(batch).astype(float))

    scored = files.saved(missing.mapInPandas(run, "desc_md5 string, hypothesis string, logit double"), "logits")
    n = scored.count()
    if n:
        scored.withColumn("part", part).repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return n


def early_exit(profile: DepthProfile) -> Column:
    """Whether a pair stops after the entailment signal."""
    return F.lit(profile.early_exit) & (F.col("nli") < 0.20) & (F.col("kw") < 0.10)


def fund_rejected() -> Column:
    """Whether a fund or a real estate trust is mentioned too little to count as a company."""
    name, mention = F.lower("name"), F.col("mention")
    fund = F.lit(False)
    for mark in FUND_MARKS:
        fund = fund | F.contains(name, F.lit(mark))
    estate = F.contains("combined_text", F.lit("real estate investment trust")) | F.contains(name, F.lit("reit"))
    return (fund & (mention < 0.2)) | (estate & (mention < 0.15) & (F.col("nli") < 0.3))


def relevance(df: DataFrame, profile: DepthProfile) -> DataFrame:
    """Add ``total`` and ``relevant`` from nli, kw, mention and entity signals, early exit and fund filters included."""
    nli, kw, mention, entity = (F.col(c) for c in ("nli", "kw", "mention", "entity"))
    total = nli * 0.65 + kw * 0.15 + mention * 0.10 + entity * 0.10
    good = (total >= 0.15 + profile.stricter) | ((nli >= 0.30) & (kw >= 0.15)) | (mention >= 0.20) | (nli >= 0.40)
    return df.withColumn("total", total).withColumn("relevant", good & ~early_exit(profile) & ~fund_rejected())


def final_score(df: DataFrame, mentions: str = "n_mentions") -> DataFrame:
    score = F.col("sim") + F.col("nli") * 0.30 + F.col("kw") * 0.20 + F.least(F.lit(0.15), F.col(mentions) * 0.04)
    return df.withColumn("relevance_score", score)


def adaptive_top_n(df: DataFrame, top: int = 50, sure: int = 10, drop: float = 0.15) -> DataFrame:
    """Best ``top`` rows per topic, cut after rank ``sure`` where the score falls ``drop`` below that rank's."""
    down = Window.partitionBy("topic_id").orderBy(F.desc("relevance_score"), "ticker")
    whole = Window.partitionBy("topic_id")
    rows = df.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= top)
    rows = rows.withColumn("edge", F.max(F.when(F.col("rank") == sure, F.col("relevance_score"))).over(whole))
    falls = (F.col("rank") > sure) & (F.col("relevance_score") < F.col("edge") - drop)
    rows = rows.withColumn("cut", F.min(F.when(falls, F.col("rank"))).over(whole))
    return rows.where(F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).drop("edge", "cut")


def attach_scores(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """Matches with their tickers' scores; tickers without data keep nulls."""
    return matches.join(scored, "ticker", "left")


def entity_score(df: DataFrame, text: str = "combined_text") -> DataFrame:
    """Add ``entity``: share of ``entities`` that occur in the company's text or ticker; 0 without any."""
    hits = F.size(F.filter("entities", lambda e: F.contains(text, e) | F.contains(F.lower("ticker"), e)))
    return df.withColumn("entity", F.when(F.coalesce(F.size("entities"), F.lit(0)) > 0, hits / F.size("entities")).otherwise(0.0))


def corpus_guard(articles: DataFrame, least: int = 10) -> DataFrame:
    """All articles, or none where there are fewer than ``least``."""
    enough = articles.limit(least).agg((F.count("*") >= least).alias("_enough"))
    return articles.join(F.broadcast(enough), F.col("_enough")).drop("_enough")
