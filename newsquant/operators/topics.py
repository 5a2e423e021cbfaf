"""Topics: assignment by size, terms by class-based TF-IDF, centroids, domain signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import DOMAIN_MARKS, GENERIC_TERMS
from ..sources import files
from .text import clean_tokens, ngrams

#: Characters of text whose n-grams a task counts at most, where texts are dealt evenly.
PART_CHARS = 2_000_000


def assign_topics(members: DataFrame, min_size: int = 8) -> DataFrame:
    """``(article_id, topic_id)`` with topics below ``min_size`` turned to noise, -1."""
    sizes = members.groupBy("topic_id").agg(F.count("*").alias("size"))
    out = members.join(sizes, "topic_id")
    return out.select("article_id", F.when(F.col("size") < min_size, -1).otherwise(F.col("topic_id")).alias("topic_id"))


def topic_terms(articles: DataFrame, n: int = 8, low: int = 1, high: int = 3) -> DataFrame:
    """Top ``n`` n-grams of each topic of ``articles(topic_id, fulltext)`` by class-based TF-IDF."""
    own = articles.where("topic_id >= 0").select("topic_id", "fulltext")
    # so many parts that none has many more than a part's characters, however many there are
    chars = own.agg(F.sum(F.length("fulltext"))).first()[0] or 0
    parts = max(articles.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    # dealt to all tasks, as texts with a topic may lie in few files
    tokens = own.repartition(parts).select("topic_id", clean_tokens(F.col("fulltext")).alias("tokens"))
    # dealt by term before they are counted, as a count within a part of the texts holds nearly all of its n-grams
    dealt = tokens.select("topic_id", F.explode(ngrams(F.col("tokens"), low, high)).alias("term")).repartition(parts, "topic_id", "term")
    counts = dealt.groupBy("topic_id", "term").agg(F.count("*").alias("tf")).repartition(parts, "term")
    # counted once, with the sum of each term beside: sums by class and over all come from the counts
    counts = files.saved(counts.withColumn("f", F.sum("tf").over(Window.partitionBy("term"))), "terms")
    classes = counts.groupBy("topic_id").agg(F.sum("tf").alias("class_total"))
    mean = classes.agg(F.avg("class_total").alias("mean_total"))
    # topics are few, so terms stay where they are until each part has its best
    scored = counts.join(F.broadcast(classes), "topic_id").join(F.broadcast(mean))
    scored = scored.withColumn("weight", F.round(F.col("tf") / F.col("class_total") * F.log1p(F.col("mean_total") / F.col("f")), 9))
    # a topic's terms fall into groups: the n-th best of the groups' best is reached by n terms at least, so only few are sorted
    groups = scored.groupBy("topic_id", F.pmod(F.xxhash64("term"), F.lit(64 * n)).alias("group")).agg(F.max("weight").alias("weight"))
    down = Window.partitionBy("topic_id").orderBy(F.desc("weight"))
    least = groups.withColumn("place", F.row_number().over(down)).where(F.col("place") == n).select("topic_id", F.col("weight").alias("least"))
    few = scored.join(F.broadcast(least), "topic_id", "left").where(F.col("least").isNull() | (F.col("weight") >= F.col("least")))
    best = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    return few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("topic_id", "rank", "term", "weight")


def topic_centroids(vectors: DataFrame) -> DataFrame:
    """Unit mean of the vectors ``(topic_id, vec)`` of each topic; zeros if they cancel out."""
    cells = vectors.where("topic_id >= 0").select("topic_id", F.posexplode("vec").alias("i", "x"))
    means = cells.groupBy("topic_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
    vec = F.transform("cells", lambda c: c["m"])
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("norm", norm).select("topic_id", F.transform(vec, lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("centroid"))


def technical_terms(terms: DataFrame, n: int = 12) -> DataFrame:
    """``(topic_id, technical)``: the first ``n`` terms longer than three letters that are not generic."""
    rows = terms.where((F.col("rank") <= n) & (F.length("term") > 3) & ~F.lower("term").isin(*sorted(GENERIC_TERMS)))
    return rows.groupBy("topic_id").agg(F.sort_array(F.collect_set(F.lower("term"))).alias("technical"))


def apply_terms(terms: DataFrame, filtered: DataFrame) -> DataFrame:
    """Filtered terms where a topic has them, its own otherwise."""
    own = terms.join(filtered.select("topic_id").distinct(), "topic_id", "left_anti")
    return own.unionByName(filtered.select(*terms.columns))


def term_score(cohesion: str, niche: str, centrality: str, generic: str, rank_share: str) -> F.Column:
    """Weighted term quality less what generic and very frequent words lose."""
    base = F.col(cohesion) * 0.40 + F.col(niche) * 0.35 + F.col(centrality) * 0.25
    common = F.when(F.col(rank_share) < 0.05, 0.20).when(F.col(rank_share) < 0.15, 0.10).otherwise(0.0)
    return base - F.when(F.col(generic), 0.20).otherwise(0.0) - common


def cut_terms(scores: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """Terms of each topic before the widest score gap, or before the first negative score; ``low`` to ``high`` of them.

    A gap counts from rank ``low`` on, up to the last but one; of equal gaps the first counts. Without
    any, ``low`` terms stay.
    """
    down = Window.partitionBy("topic_id").orderBy(F.desc("score"), "term")
    rows = scores.withColumns({"rank": F.row_number().over(down), "before": F.lag("score").over(down), "n": F.count("*").over(Window.partitionBy("topic_id"))})
    at = F.col("rank") - 1
    inside = (at >= low) & (at < F.least(F.col("n") - 1, F.lit(high + 1)))
    cut = rows.groupBy("topic_id").agg(
        F.max(F.when(inside, F.struct((F.col("before") - F.col("score")).alias("gap"), (-at).alias("at")))).alias("widest"),
        F.min(F.when(F.col("score") < 0, at)).alias("negative"),
    )
    place = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(-F.col("widest.at"), F.lit(low))))
    place = F.least(place, F.greatest(F.lit(low), F.coalesce(F.col("negative"), F.lit(high))))
    return rows.join(cut.select("topic_id", place.alias("keep")), "topic_id").where("rank <= keep").select("topic_id", "term", "score", "rank")


def vocabulary(articles: DataFrame) -> DataFrame:
    """``(word, rank, share)`` of the words of ``articles(fulltext)``: how many words are more frequent, and their share."""
    counts = articles.select(F.explode(clean_tokens(F.col("fulltext"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = files.saved(counts, "vocabulary")  # the texts are read once
    sizes = counts.groupBy("n").agg(F.count("*").alias("many"))  # as many rows as there are different counts
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("n", F.coalesce(F.sum("many").over(above), F.lit(0)).alias("rank"), F.sum("many").over(Window.partitionBy()).alias("whole"))
    return counts.join(ranks, "n").select("word", "rank", (F.col("rank") / F.col("whole")).alias("share"))


def term_metrics(terms: DataFrame, words: DataFrame, generic: DataFrame) -> DataFrame:
    """``(topic_id, term, rank, cohesion, centrality, niche, generic, share)`` of single-word terms with a vector.

    ``words(word, share, vec)`` is the vocabulary, ``generic(word)`` its generic words. Cohesion is the
    mean cosine to a topic's other words, centrality the share of cosines above 0.4, niche the
    distance to the mean generic vector by the topic's largest.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = terms.where(~F.contains("term", F.lit(" "))).select("topic_id", "rank", "term").join(words.select(F.col("word").alias("term"), "share", "vec"), "term")
    own = own.withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    other = own.select("topic_id", F.col("term").alias("other"), F.col("vec").alias("other_vec"), F.col("norm").alias("other_norm"))
    pairs = own.join(other, "topic_id").where("term <> other").withColumn("cos", F.try_divide(dot(F.col("vec"), F.col("other_vec")), F.col("norm") * F.col("other_norm")))
    close = pairs.groupBy("topic_id", "term").agg(F.avg("cos").alias("cohesion"), F.avg(F.when(F.col("cos") > 0.4, 1.0).otherwise(0.0)).alias("centrality"))
    marked = generic.select(F.col("word").alias("term")).distinct()
    cells = words.join(marked, words["word"] == marked["term"], "left_semi").select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    center = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("center"))
    rows = own.join(close, ["topic_id", "term"], "left").join(center).join(marked.withColumn("generic", F.lit(True)), "term", "left")
    away = F.sqrt(F.aggregate(F.zip_with("vec", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("away", F.when(F.size("center") > 0, away).otherwise(0.0))
    most = F.max("away").over(Window.partitionBy("topic_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.select("topic_id", "term", "rank", zero("cohesion"), zero("centrality"), F.coalesce(F.try_divide(F.col("away"), most), F.lit(0.0)).alias("niche"), F.coalesce("generic", F.lit(False)).alias("generic"), "share")


def filter_terms(terms: DataFrame, scores: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """Terms of each topic: domain phrases, then scored words that :func:`cut_terms` keeps in their own order, ``high`` in all.

    Each domain phrase over ``high`` takes one of the words' last away. Topics with fewer than ``low``
    scored words keep their first ``low`` terms.
    """
    enough = scores.groupBy("topic_id").agg(F.count("*").alias("n")).where(F.col("n") >= low).select("topic_id")
    mark = F.lit(False)
    for word in DOMAIN_MARKS:
        mark = mark | F.contains("term", F.lit(word))
    phrases = terms.join(enough, "topic_id", "left_semi").where(F.contains("term", F.lit(" ")) & mark).select("topic_id", "term", "weight", F.lit(0).alias("first"), "rank")
    kept = cut_terms(scores, low, high).select("topic_id", "term")
    kept = terms.join(kept, ["topic_id", "term"], "left_semi").join(enough, "topic_id", "left_semi").select("topic_id", "term", "weight", F.lit(1).alias("first"), "rank")
    few = terms.join(enough, "topic_id", "left_anti").where(F.col("rank") <= low).select("topic_id", "term", "weight", F.lit(0).alias("first"), "rank")
    whole = Window.partitionBy("topic_id")
    place, n = F.row_number().over(whole.orderBy("first", "rank")), F.count("*").over(whole)
    rows = phrases.unionByName(kept).unionByName(few).withColumns({"place": place, "n": n, "ahead": F.count_if(F.col("first") == 0).over(whole)})
    last = F.when(F.col("ahead") <= high, F.lit(high)).otherwise(F.col("n") + high - F.col("ahead"))
    return rows.where((F.col("first") == 0) | (F.col("place") <= last)).select("topic_id", F.col("place").alias("rank"), "term", "weight")


def domain_signals(terms: DataFrame, articles: DataFrame) -> DataFrame:
    """``(topic_id, technical, entities, topic_text, keywords)`` from terms and ``articles(topic_id, article_id, keywords, entities)``.

    Entities are words of over two letters of the first 15 articles; the text is the first 15 terms
    and the keywords of the first 10 articles.
    """
    order = Window.partitionBy("topic_id").orderBy("article_id")
    first = articles.withColumn("seq", F.row_number().over(order)).where("seq <= 15")
    words = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split(F.lower("entities"), " "))), lambda w: F.length(w) > 2)))
    said = F.array_sort(F.collect_list(F.when(F.col("seq") <= 10, F.struct("seq", F.coalesce("keywords", F.lit("")).alias("k")))))
    heard = first.groupBy("topic_id").agg(words.alias("entities"), F.array_join(F.transform(said, lambda s: s["k"]), " ").alias("said"))
    top = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "term")))), lambda s: s["term"])
    named = terms.groupBy("topic_id").agg(top(8).alias("keywords"), F.array_join(top(15), " ").alias("named"))
    out = named.join(technical_terms(terms), "topic_id", "left").join(heard, "topic_id", "left")
    return out.select("topic_id", "technical", "entities", F.lower(F.concat_ws(" ", "named", "said")).alias("topic_text"), "keywords")
