"""Selection of articles for groups of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mentions import phrase_hits, saved_index


def select_articles(articles: DataFrame, asked: DataFrame, since: Column | None = None, until: Column | None = None, most: int = 100, least_chars: int = 300, buckets: int = 64) -> DataFrame:
    """``(query_id, article_id, hits, place)``: the best ``most`` articles of each query of ``asked(query_id, alternatives)`` by hits.

    ``articles(article_id, body, date)`` are those of the window from ``since`` to ``until``, ends included,
    with over ``least_chars`` characters. A hit is an alternative as words of its own, in any case;
    hits are looked up in an index of words. Ties go to the smaller article. An article may be
    selected for several queries. The best are taken within ``buckets`` of articles first, so no task holds
    all that a query finds.
    """
    rows = articles.where(F.length("body") > least_chars)
    rows = rows if since is None else rows.where(F.col("date") >= since)
    rows = rows if until is None else rows.where(F.col("date") <= until)
    phrases = asked.select(F.col("query_id").alias("ticker"), F.explode("alternatives").alias("phrase")).select("ticker", F.lower(F.trim("phrase")).alias("phrase"), F.lit(False).alias("tight"))
    hits = phrase_hits(saved_index(rows, phrases), phrases)
    found = hits.groupBy(F.col("ticker").alias("query_id"), "article_id").agg(F.count("*").alias("hits"))
    best = lambda *keys: F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(F.desc("hits"), "article_id"))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(buckets)))
    first = dealt.withColumn("place", best("bucket")).where(F.col("place") <= most)
    return first.withColumn("place", best()).where(F.col("place") <= most).select("query_id", "article_id", "hits", "place")
