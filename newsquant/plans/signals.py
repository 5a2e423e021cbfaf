"""Queries over mentions, term quality, company records, page bodies and report files; and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import DOMAIN_MARKS, FUND_MARKS, GENERIC_NOUNS, PHRASE_EXACT, PHRASE_FIRST, PHRASE_LAST, PHRASE_PARTS, PHRASE_STOPS
from ..operators import matching, mentions, pages, reporting, text, topics, vectors
from ..sources import files, fixtures, readers
from ..streaming import status
from . import articles, stocks
from .shared import once

quote = "'{}'".format
Query = Callable[[SparkSession, str], DataFrame]
_SAID = "array_join(mentioned_as, '; ') as mentioned_as"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.count_mentions(articles._bodies(spark, sf_dir), articles._companies(spark, sf_dir))


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _counted(spark, sf_dir).select("article_id", "ticker", F.explode("mentioned_as").alias("said"))
    return said.where(F.col("said").rlike(r"^[a-z]{3} \("))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies, firms = articles._bodies(spark, sf_dir), articles._companies(spark, sf_dir)
    index = mentions.saved_index(bodies, mentions.spellings(firms), mentions.symbols(firms))
    return mentions.validate_mentions(mentions.count_mentions(bodies, firms, index), bodies, firms, index).where("valid").select("article_id", "ticker")


@once
def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with vectors of eight numbers from hash digits."""
    digit = lambda i: F.conv(F.substring(F.md5("word"), 1 + 4 * i, 4), 16, 10).cast("double") / 32767.5 - 1
    return topics.vocabulary(articles._articles(spark, sf_dir)).select("word", "rank", "share", F.array(*[digit(i) for i in range(8)]).alias("vec"))


def _term_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    return topics.term_metrics(articles._terms(spark, sf_dir), words, words.where(F.startswith(F.md5("word"), F.lit("0"))))


@once
def _term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = topics.term_score("cohesion", "niche", "centrality", "generic", "share")
    return _term_metrics(spark, sf_dir).select("topic_id", "term", "rank", F.round(score, 6).alias("score"))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.filter_terms(articles._terms(spark, sf_dir), _term_scores(spark, sf_dir).drop("rank"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = text.extract_keywords(articles._topic_articles(spark, sf_dir)).select("topic_id", "article_id", "keywords", F.substring("fulltext", 1, 200).alias("entities"))
    out = topics.domain_signals(articles._terms(spark, sf_dir), own)
    return out.select("topic_id", F.array_join("technical", "|").alias("technical"), F.md5(F.array_join("entities", "|")).alias("entities_md5"), F.md5("topic_text").alias("text_md5"), F.array_join("keywords", "|").alias("keywords"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the raw profile table: every company, some without a long name or a description."""
    n = F.col("n")
    return articles._raw_companies(spark, sf_dir).where("Ticker <> ''").select(
        F.col("Ticker").alias("ticker"), F.when(n % 3 == 0, " ").otherwise(F.trim("Name")).alias("longName"), F.trim("Name").alias("shortName"),
        F.when(n % 5 == 0, "").otherwise(F.col("Description")).alias("longBusinessSummary"), F.when(n % 2 == 0, "tools").alias("sector"), F.lit(None).cast("string").alias("industry"),
    )


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.assemble_companies(_profiles(spark, sf_dir), text.company_keywords(articles._companies(spark, sf_dir)))
    return out.select("Ticker", "Name", F.md5("Description").alias("description_md5"), "Keywords", "Sector", "Industry")


def _cik_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("a\tb\t"), key)).otherwise(F.concat(F.lit(" sym"), (F.col("c_custkey") % 40).cast("string"), F.lit("\t"), key))
    return fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"), line.alias("line"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as filing elements; some become item headings."""
    rows = articles._paragraphs(spark, sf_dir)
    shown = F.when((F.col("pos") == 1) & (F.col("doc") % 3 > 0), "Item 1. Business").when((F.col("pos") == 5) & (F.col("doc") % 2 == 0), " item 1A Risk Factors").otherwise(F.col("text"))
    return rows.select(F.col("doc").alias("filing"), "pos", shown.alias("text"))


def _report30(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = articles._terms(spark, sf_dir).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]), ", ").alias("topic_keywords"))
    said = mentions.mention_variants(*articles._topic_bodies(spark, sf_dir)).withColumnRenamed("ticker", "company")
    rows = articles._report(spark, sf_dir).join(keywords, "topic_id").join(said, ["topic_id", "company"], "left")
    rows = rows.drop("ticker").withColumnRenamed("company", "ticker")
    scores = {f"{s}_score": F.round(f"{s}_score", 6) for s in ("day", "swing", "position", "longterm")}
    return reporting.report_rows(rows.withColumns(scores))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, written and read again."""
    rows, path = _report30(spark, sf_dir), files.scratch_path(spark, "report")
    readers.write_report(rows, path)
    return readers.read_report(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)).fillna("", ["Mentioned_As"])


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    base = F.when(key % 3 == 0, "topic_companies_multitimeframe").when(key % 3 == 1, "user7_topic_companies").otherwise("topics")
    depth = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("_depth-"), (key % 4 + 1).cast("string")))
    name = F.concat(F.lit("/reports/"), base, depth, F.lit("_"), F.date_format(F.col("o_orderdate").cast("date"), "MM-dd-yyyy"), F.lit("_"), F.lpad((key % 24).cast("string"), 2, "0"), F.lit(".csv"))
    return reporting.report_catalog(fixtures.table(spark, sf_dir, "orders").select(name.alias("path"), key.alias("length")))


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that each depth's similarity and keyword gates leave, and the sentences it asks about."""
    # written, as each depth reads it and texts are searched once
    base, out = files.saved(articles._candidates(spark, sf_dir, 0.03, "combined_text").select("ticker", "sim", "kw"), "pairs"), None
    for depth in (1, 2, 3, 4):
        own = matching.DepthProfile.of(depth)
        gated = matching.stage1_gate(base.where(F.col("sim") >= own.min_similarity), own)
        row = gated.agg(F.lit(depth).alias("depth"), F.count("*").alias("pairs"), F.countDistinct("ticker").alias("companies"), F.lit(own.hypotheses * 2).alias("sentences"))
        out = row if out is None else out.unionByName(row)
    return out


def _funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles._decided(spark, sf_dir)
    return rows.select("topic_id", "ticker", matching.fund_rejected().alias("fund"), matching.early_exit(articles.PROFILE).alias("exits"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles._articles(spark, sf_dir).select("article_id", F.md5(F.substring("fulltext", 1, 400)).alias("key"))
    out = vectors.with_vectors(docs, articles._members(spark, sf_dir).select("article_id", "vec"), "article_id")
    return out.select("article_id", "key", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"v{i}") for i in (0, 63)])


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every English article with a vector hashed from its text."""
    return files.saved(vectors.text_vectors(articles._articles(spark, sf_dir), "article_id", "fulltext"))


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the vector of their number, and others with one hashed from their text."""
    docs = articles._articles(spark, sf_dir).select("article_id", "fulltext")
    given = articles._members(spark, sf_dir).select("article_id", "vec")
    out = vectors.with_vectors(docs, given, "article_id", "fulltext", 64)
    return out.select("article_id", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"v{i}") for i in (0, 31, 63)])


def _text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 on hashed vectors: topics by their articles' texts, companies by the first 400 characters of theirs."""
    docs = articles._articles(spark, sf_dir)
    counts = files.saved(vectors.hashed_counts(docs, "article_id", "fulltext"), "slots")  # texts are read once
    weights = files.saved(vectors.slot_weights(counts, docs.agg(F.count("*").alias("total"))))
    members = articles._members(spark, sf_dir).select("article_id", "topic_id")
    own = vectors.hashed_vectors(counts.join(members, "article_id", "left_semi"), weights, "article_id")
    centroids = topics.topic_centroids(own.join(members, "article_id"))
    firms = articles._companies(spark, sf_dir).select("ticker", F.substring("combined_text", 1, 400).alias("own_text"))
    firms = firms.join(vectors.hashed_vectors(vectors.hashed_counts(firms, "ticker", "own_text"), weights, "ticker"), "ticker")
    # by a fixed number of parts, as the pairs are what takes time: by size few tasks would do them
    firms = firms.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ticker")
    return matching.similarity_join(firms, centroids, 0.3).select("topic_id", "ticker", F.round("sim", 6).alias("sim"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log written as files in no order of time and followed file by file, in two runs."""
    log, source, checkpoint, target = articles._jobs(spark, sf_dir), *(files.scratch_path(spark, n) for n in ("log", "state", "status"))
    for part in (0, 1):
        log.where(F.pmod(F.xxhash64("job_id", "ts"), F.lit(2)) == part).repartition(4, "ts").write.mode("append").parquet(source)
        status.follow_status(spark, source, target, checkpoint, files_at_once=2)
    return status.read_status(spark, target)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles._gated(spark, sf_dir).select("topic_id", "desc_md5").join(articles._said(spark, sf_dir), "topic_id").select("desc_md5", "hypothesis").distinct()


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, said = articles._gated(spark, sf_dir), articles._said(spark, sf_dir)
    return matching.missing_pairs(pairs, said, articles._logits(pairs, said))


def _digits_logit(rows: pd.DataFrame) -> pd.Series:
    """Stands for a model: hash digits as logits, one batch at a time."""
    return pd.Series([int(md5((d + h).encode()).hexdigest()[:6], 16) / 16777215.0 * 8 - 7 for d, h in zip(rows["desc_md5"], rows["hypothesis"])], index=rows.index)


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: what each asked the scorer, and the mean of what is known after it."""
    asked, path, rows = files.saved(_asked(spark, sf_dir)), files.scratch_path(spark, "cache"), []
    half = asked.where(F.startswith("desc_md5", F.lit("a")) | F.startswith("desc_md5", F.lit("3")))
    for run, pairs in enumerate((half, asked, asked), 1):
        n = matching.fill_logits(spark, path, pairs, _digits_logit, 1)
        # read at once: Spark takes two scans of one path for the same, whatever was appended between them
        known = matching.read_logits(spark, path).agg(F.count("*"), F.round(F.avg("logit"), 6)).first()
        rows.append((run, n, known[0], known[1]))
    return spark.createDataFrame(rows, "run int, asked long, known long, mean_logit double")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the companies: the second lacks every seventh, and some names and descriptions."""
    raw = _profiles(spark, sf_dir).withColumn("h", F.conv(F.substring(F.md5("ticker"), 1, 4), 16, 10).cast("long"))
    words = text.company_keywords(articles._companies(spark, sf_dir))
    old = readers.assemble_companies(raw, words)
    new = readers.assemble_companies(raw, words.where("rank <= 3")).join(raw.select(F.col("ticker").alias("Ticker"), "h"), "Ticker").where("h % 7 > 0")
    blank = lambda c, n: F.when(F.col("h") % n == 0, " ").otherwise(F.col(c)).alias(c)
    new = new.select("Ticker", blank("Name", 3), blank("Description", 2), "Keywords", F.lit("new").alias("Sector"), "Industry")
    path = files.scratch_path(spark, "companies")
    readers.update_companies(spark, path, old)
    return readers.update_companies(spark, path, new).select("Ticker", "Name", F.md5("Description").alias("description_md5"), "Keywords", "Sector", "Industry")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all symbols, written hour after hour from the last day of the bars, then listed from their files."""
    rows = stocks._scored(spark, sf_dir)
    rows = rows.select("*", F.lit(1).alias("topic_id"), F.lit("all").alias("topic_keywords"), F.col("ticker").alias("name"), F.col("swing_score").alias("relevance_score"), F.lit(0).alias("n_mentions"), F.array().cast("array<string>").alias("mentioned_as"))
    report, folder = files.saved(reporting.report_rows(rows)), files.scratch_path(spark, "reports")
    day = fixtures.bars(spark, sf_dir).agg(F.max("bar_date")).first()[0]
    for hours, depth, user in ((5, 1, None), (30, 2, None), (7, 3, "user7"), (6, 4, None)):
        readers.write_named_report(report, folder, depth, datetime.combine(day, datetime.min.time()) + timedelta(hours=hours), user)
    return reporting.report_catalog(readers.list_files(spark, folder)).where("length > 0").drop("length")


def queries() -> dict[str, Query]:
    return {
        "T6_extract_bodies": lambda s, d: pages.extract_bodies(fixtures.table(s, d, "pages")).select("page_id", F.md5("body").alias("body_md5"), F.length("body").alias("chars")),
        "T8_mention_counts": lambda s, d: _counted(s, d).selectExpr("article_id", "ticker", "mentions", _SAID),
        "T9_short_symbols": _short,
        "T10_valid_mentions": _valid,
        "T11_clean_description": lambda s, d: articles._companies(s, d).select("ticker", F.md5(text.clean_description(F.regexp_replace("description", r"[^\x00-\x7F]", " "), F.col("name"))).alias("cleaned_md5")),
        "T12_company_keywords": lambda s, d: text.company_keywords(articles._companies(s, d)).withColumn("score", F.round("score", 9)),
        "T14_extract_section": lambda s, d: text.extract_section(_elements(s, d)).groupBy("filing").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars")),
        "T17_similar_articles": lambda s, d: vectors.drop_similar(articles._members(s, d).select("article_id", "vec")).select("article_id"),
        "T17_similar_texts": lambda s, d: vectors.drop_alike(_hashed(s, d)).select("article_id"),
        "M1_with_vectors": _vectors,
        "M1_hashed_vectors": _fallback,
        "M2_cluster_topics": lambda s, d: vectors.cluster_topics(articles._members(s, d).select("article_id", "vec")),
        "J1_text_similarity": _text_similarity,
        "M4_term_metrics": lambda s, d: _term_metrics(s, d).select("topic_id", "term", *[F.round(c, 6).alias(c) for c in ("cohesion", "centrality", "niche", "share")], "generic"),
        "M5_term_scores": lambda s, d: _term_scores(s, d).drop("rank"),
        "M6_filter_terms": lambda s, d: _filtered(s, d).drop("weight"),
        "M7_apply_terms": lambda s, d: topics.apply_terms(articles._terms(s, d).select("topic_id", "rank", "term", "weight"), _filtered(s, d).where("topic_id % 2 = 0")),
        "M9_domain_signals": _signals,
        "J6_J9_rejections": _funds,
        "J8_mention_score": lambda s, d: mentions.mention_score(*articles._topic_bodies(s, d)).select("topic_id", "ticker", "n_mentions", F.round("mention", 6).alias("mention")),
        "J12_mention_variants": lambda s, d: mentions.mention_variants(*articles._topic_bodies(s, d)).selectExpr("topic_id", "ticker", _SAID),
        "J15_depth_profiles": _depths,
        "S2_sample_companies": lambda s, d: readers.sample_companies(articles._companies(s, d), 60, ["THE", "AND", "NONE"], 3).select("ticker", "name"),
        "S6_cik_map": lambda s, d: readers.parse_cik_lines(_cik_lines(s, d)),
        "S8_report_text": lambda s, d: reporting.report_text(_report30(s, d)),
        "S9_read_report": _written,
        "S10_report_catalog": _catalog,
        "S10_written_reports": _listed,
        "S11_company_lookup": lambda s, d: readers.company_lookup(articles._companies(s, d)),
        "S12_assemble_companies": _assembled,
        "S12_merge_snapshots": _merged,
        "R10_status_stream": _streamed,
        "J5_missing_pairs": _missing,
        "J5_logit_cache": _cached,
        "R3_report": _report30,
        "R9_user_jobs": lambda s, d: reporting.user_jobs(fixtures.table(s, d, "events").select(F.col("event_id").alias("job_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at")), 7),
    }


def bodies_sql() -> str:
    """Bodies of pages: each tag's partner is the next tag of its name on the same level."""
    quoted = lambda x: x.replace("'", "''")
    html = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for tag in ("script", "style"):
        html = f"regexp_replace({html}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', '', 'g')"
    value = lambda name: " || ".join(f"""regexp_extract(text, '(?is)\\s{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', {i})""" for i in (1, 2, 3))
    kind = " ".join(f"when {f'tag = {chr(39)}{word}{chr(39)}' if where == 'tag' else f'contains({where}, {chr(39)}{word}{chr(39)})'} then {rank}" for rank, (where, word) in enumerate(pages.PLACES))
    plain = "text"
    for name, char in pages.ENTITIES:
        plain = f"replace({plain}, '{name}', '{quoted(char)}')"
    return f"""with tok as (select page_id as page, unnest(t) as text, generate_subscripts(t, 1) as pos from (select page_id, regexp_extract_all({html}, '{quoted(pages.TOKEN)}') as t from pages)),
named as (select *, nullif(lower(regexp_extract(text, '^</?([a-zA-Z][^\\s/>]*)', 1)), '') as raw, starts_with(text, '</') as ends from tok),
tags as (select page, text, pos, ends, case when regexp_matches(text, '(?s)^<[a-zA-Z].*/>$') or raw in ({articles._texts(pages.VOID_TAGS)}) then null else raw end as tag from named),
marked as (select *, case when tag is not null and not ends then {value('class')} else '' end as class, case when tag is not null and not ends then {value('id')} else '' end as id from tags),
summed as (select *, sum(case when ends then -1 else 1 end) over (partition by page, tag order by pos) as d from marked where tag is not null),
floored as (select *, d - least(0, min(d) over (partition by page, tag order by pos rows between unbounded preceding and current row)) as depth from summed),
levels as (select *, case when ends and depth = 0 and coalesce(lag(depth) over (partition by page, tag order by pos), 0) = 0 then null when ends then depth + 1 else depth end as level from floored),
partners as (select page, pos, tag, ends, case when ends then lag(pos) over w else lead(pos) over w end as other, case when ends then lag(class) over w else class end as class, case when ends then lag(id) over w else id end as id from levels where level is not null window w as (partition by page, tag, level order by pos)),
furniture as (select page, pos as start, coalesce(other, 2147483647) as stop from partners where not ends and (tag in ({articles._texts(pages.BARE_TAGS)}) or regexp_matches(class, '(?i){pages.FURNITURE}') or regexp_matches(id, '(?i){pages.FURNITURE}'))),
stays as (select * from tags t where not exists (select 1 from furniture f where f.page = t.page and t.pos between f.start and f.stop)),
found as (select page, min(row(case {kind} end, pos, coalesce(other, 2147483647))) as spot from partners semi join stays using (page, pos) where not ends and (case {kind} end) is not null group by 1),
inner_ as (select stays.* from stays left join found using (page) where spot is null or (pos > spot[2] and pos < spot[3])),
last_ as (select *, last_value(case when tag = 'p' then row(pos, ends) end ignore nulls) over (partition by page order by pos) as p from inner_),
pieces as (select page, p[1] as paragraph, string_agg(regexp_replace({plain}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '' order by pos) as text from last_ where tag is null and not starts_with(text, '<') and p is not null and not p[2] group by 1, 2),
bodies as (select page as page_id, substr(string_agg(text, ' ' order by paragraph), 1, 50000) as body from pieces where length(text) > 40 group by 1)
select page_id, md5(body) as body_md5, length(body)::int as chars from bodies where length(body) > 300"""


def hashed_sql(rows: str, key: str, dims: int, weights: str = "") -> str:
    """Expressions ``cells``, ``idf`` and ``hashed(key, vec)`` of ``rows(key, x)``, named with ``key`` as suffix."""
    one, two = f"select {key}, unnest(t) as term from tokens_{key}", f"select {key}, z[1] || ' ' || z[2] as term from (select {key}, unnest(list_zip(t[:-2], t[2:])) as z from tokens_{key} where len(t) >= 2)"
    idf = weights or f"idf_{key}"
    own = "" if weights else f"idf_{key} as (select slot, ln(((select count(*) from tokens_{key}) + 1) / (count(*) + 1)::double) as idf from cells_{key} group by 1),"
    return f"""tokens_{key} as (select {key}, {articles._sql_tokens("coalesce(x, '')")} as t from ({rows})),
cells_{key} as (select {key}, (('0x' || substr(md5(term), 1, 8))::bigint % {dims})::int as slot, count(*) as n from ({one} union all {two}) group by 1, 2), {own}
heavy_{key} as (select {key}, slot, n * idf as x from cells_{key} join {idf} using (slot)),
norms_{key} as (select {key}, sqrt(sum(x * x)) as norm, map_from_entries(list(row(slot, x))) as held from heavy_{key} group by 1),
hashed_{key} as (select {key}, list_transform(range(0, {dims}), lambda i: coalesce(held[i::int] / nullif(norm, 0), 0)) as vec from tokens_{key} left join norms_{key} using ({key}))"""


def oracle_sql() -> dict[str, str]:
    known = articles.oracle_sql()
    match = known["J10_relevance"].rpartition(" select ")[0].removeprefix("with ")
    whole = known["J2_keyword_score"].rpartition(" select ")[0].removeprefix("with ")
    report = known["J14_attach_scores"].rpartition(" select ")[0].removeprefix("with ")
    firms = articles.companies_sql()
    list_ = articles._texts
    every = f"{firms}, {articles.mentions_sql('art', 'body', 1 << 30)}"
    near = f"{firms}, {articles.mentions_sql('(select article_id, body from art semi join (select article_id from first where seq <= 15) using (article_id))', 'body')}"
    low = f"{firms}, {articles.mentions_sql('(select article_id, body from art semi join (select article_id from first where seq <= 10) using (article_id))', 'lower(body)')}"
    ten = "variants10 as (select topic_id, ticker, list_sort(list(distinct said)) as mentioned_as from (select topic_id, ticker, unnest(mentioned_as) as said from first join counted using (article_id) where seq <= 10) group by 1, 2)"
    words = f"""vocab as (select word, count(*) as n from (select unnest({articles._sql_tokens('fulltext')}) as word from articles) group by 1),
words as (select word, (rank() over (order by n desc) - 1)::bigint as rank, (rank() over (order by n desc) - 1) / count(*) over ()::double as share, [{", ".join(f"('0x' || substr(md5(word), {1 + 4 * i}, 4))::bigint / 32767.5::double - 1" for i in range(8))}] as vec from vocab),
center as (select list(x order by i) as center from (select i, avg(vec[i]) as x from (select vec, unnest(range(1, 9)) as i from words where starts_with(md5(word), '0')) group by 1)),
own as (select topic_id, rank, term, w.share, w.vec, sqrt(list_dot_product(w.vec, w.vec)) as norm from terms join (select word as term, share, vec from words) w using (term) where not contains(term, ' ')),
close_ as (select a.topic_id, a.term, avg(list_dot_product(a.vec, b.vec) / (a.norm * b.norm)) as cohesion, avg(case when list_dot_product(a.vec, b.vec) / (a.norm * b.norm) > 0.4 then 1.0 else 0.0 end) as centrality from own a join own b on a.topic_id = b.topic_id and a.term <> b.term group by 1, 2),
away as (select *, case when center is null then 0 else sqrt(list_sum(list_transform(list_zip(vec, center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) end as away from own, center),
term_metrics as (select topic_id, term, rank, coalesce(cohesion, 0) as cohesion, coalesce(centrality, 0)::double as centrality, coalesce(away / nullif(max(away) over (partition by topic_id), 0), 0) as niche, starts_with(md5(term), '0') as generic, share from away left join close_ using (topic_id, term)),
term_scores as (select topic_id, term, rank, round(cohesion * 0.40 + niche * 0.35 + centrality * 0.25 - (case when generic then 0.20 else 0 end) - (case when share < 0.05 then 0.20 when share < 0.15 then 0.10 else 0 end), 6) as score from term_metrics),
ordered as (select *, row_number() over w as r, lag(score) over w as before, count(*) over (partition by topic_id) as n from term_scores window w as (partition by topic_id order by score desc, term)),
cuts as (select topic_id, max(n) as n, arg_max(r - 1, before - score - (r - 1) / 1e9) filter (r - 1 >= 3 and r - 1 < least(n - 1, 6)) as gap, min(r - 1) filter (score < 0) as negative from ordered group by 1),
bounds as (select topic_id, n, least(greatest(3, least(5, coalesce(gap, 3))), greatest(3, coalesce(negative, n))) as keep from cuts),
enough as (select topic_id, keep from bounds where n >= 3),
chosen as (select t.topic_id, t.term, t.weight, t.rank, 0 as first from terms t join enough using (topic_id) where contains(t.term, ' ') and ({' or '.join(f"contains(t.term, '{m}')" for m in DOMAIN_MARKS)})
  union all select o.topic_id, o.term, t.weight, t.rank, 1 from ordered o join enough using (topic_id) join terms t on t.topic_id = o.topic_id and t.term = o.term where o.r <= keep
  union all select topic_id, term, weight, rank, 0 from terms where rank <= 3 and topic_id not in (select topic_id from enough)),
filtered as (select topic_id, place as rank, term, weight from (select *, row_number() over (partition by topic_id order by first, rank)::int as place, count(*) filter (first = 0) over (partition by topic_id) as ahead, count(*) filter (first = 1) over (partition by topic_id) as words from chosen)
  where first = 0 or place - ahead <= case when 5 - ahead >= 0 then 5 - ahead else words + 5 - ahead end)"""
    terms = known["M3_topic_terms"].removeprefix("with ").rpartition(" select ")[0]
    phrases = f"""sentences as (select ticker, lower(name) as name, list_filter(string_split_regex(s, '[^a-z]+'), lambda w: length(w) > 2 and w not in ({list_(PHRASE_STOPS)})) as toks from (select ticker, name, unnest(string_split_regex(lower(description), '[.!?\\n]+')) as s from companies)),
grams_ as ({" union all ".join(f"select ticker, name, toks[i:i + {n - 1}] as w from (select *, unnest(range(1, len(toks) - {n - 2})) as i from sentences where len(toks) >= {n})" for n in (2, 3, 4))}),
told as (select ticker, array_to_string(w, ' ') as phrase, count(*) as n, len(any_value(w)) as words from grams_ where not list_bool_or(list_transform(w, lambda x: contains(name, x))) and w[1] not in ({list_(PHRASE_FIRST)}) and w[-1] not in ({list_(PHRASE_LAST)})
  and array_to_string(w, ' ') not in ({list_(PHRASE_EXACT)}) and not ({' or '.join(f"contains(array_to_string(w, ' '), '{b}')" for b in PHRASE_PARTS)}) group by 1, 2),
phrases as (select ticker, phrase, n / (sum(n) over (partition by ticker))::double * words as score from told),
keyed as (select * from (select ticker, phrase, score, row_number() over (partition by ticker order by score desc, phrase)::int as rank from phrases) where rank <= 12)"""
    cleaned = "description"  # other scripts are blanked: engines differ on what is a word there
    for pattern in (r"The company was formerly known as[^.]*\.", r"formerly known as[^.]*\.", r"headquartered in[^.]*\.", r"based in \w+, \w+\.", r"founded in \d{4}[^.]*\."):
        cleaned = f"regexp_replace({cleaned}, '{pattern}', '', 'gi')"
    shown = lambda c, d, how: f"round({f'nullif({c}, 0) * 100' if how == 'share' else f'nullif({c}, 0)' if how else c}, {d})"
    full = ", ".join(f"{'round(' + c + ', 6)' if c.endswith('_score') and d is None else c if d is None else shown(c, d, how)} as {n}" for n, c, d, how in reporting.REPORT if n not in ("Topic_ID", "Topic_Keywords", "Ticker", "Company_Name", "Relevance_Score", "Mentions", "Mentioned_As"))
    swap = low.removeprefix(f"{firms}, ")
    for name in ("spelt", "lists", "variants", "art", "first", "asked", "kept", "both_", "spots", "counts_", "counted", "places", "tickers", "valid"):
        swap = re.sub(rf"\b{name}\b(?! =)", f"{name}x", swap) if name not in ("first",) else swap.replace("first as (", "firstx as (").replace("from first ", "from firstx ")
    tenx = ten.replace("from first join counted", "from firstx join countedx")
    rep = f"""{report}, {swap}, {tenx}, listed as (select topic_id, string_agg(term, ', ' order by rank) as topic_keywords from terms group by 1),
full_ as (select m.topic_id as Topic_ID, topic_keywords as Topic_Keywords, m.ticker as Ticker, m.name as Company_Name, round(m.relevance_score, 3) as Relevance_Score, m.n_mentions as Mentions, case when m.n_mentions > 0 then coalesce(array_to_string(mentioned_as, '; '), '') else '' end as Mentioned_As, {full}
  from matched m left join rated r on r.ticker = symbol join listed on listed.topic_id = m.topic_id left join variants10 v on v.topic_id = m.topic_id and v.ticker = m.ticker)"""
    texts = ", ".join(n if d is None else f"coalesce(printf('%.{d}f', {n}::double), '') as {n}" for n, _, d, _ in reporting.REPORT)
    funds = " or ".join(f"contains(lower(name), '{m}')" for m in FUND_MARKS)
    gates = " union all ".join(f"select {k}::int as depth, count(*) as pairs, count(distinct ticker) as companies, {p.hypotheses * 2}::int as sentences from deep where sim >= {p.min_similarity} and (kw >= {p.min_keyword} or sim >= 0.15)" for k in (1, 2, 3, 4) for p in (matching.DepthProfile.of(k),))
    generic = list_(GENERIC_NOUNS)
    return {
        "T6_extract_bodies": bodies_sql(),
        "T8_mention_counts": f"with {every} select article_id, ticker, mentions, array_to_string(mentioned_as, '; ') as mentioned_as from counted",
        "T9_short_symbols": f"with {every} select * from (select article_id, ticker, unnest(mentioned_as) as said from counted) where regexp_matches(said, '^[a-z]{{3}} \\(')",
        "T10_valid_mentions": f"with {every} select article_id, ticker from valid",
        "T11_clean_description": f"""with recursive {firms}, lw as (select ticker, regexp_replace(description, '[^\\x00-\\x7F]', ' ', 'g') as description, list_filter(string_split(name, ' '), lambda w: length(w) > 4) as ws from companies),
bare as (select ticker, description, ws, 1 as i from lw union all select ticker, regexp_replace(description, '\\b' || regexp_escape(ws[i]) || '\\b', '', 'gi'), ws, i + 1 from bare where i <= len(ws))
select ticker, md5({cleaned}) as cleaned_md5 from bare where i = len(ws) + 1""",
        "T12_company_keywords": f"with {firms}, {phrases} select ticker, phrase, round(score, 9) as score, rank from keyed",
        "T14_extract_section": """with e as (select doc_id as filing, (pos - 1)::int as pos, case when pos = 2 and doc_id % 3 > 0 then 'Item 1. Business' when pos = 6 and doc_id % 2 = 0 then ' item 1A Risk Factors' else text end as text from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
a as (select *, sum(length(text)) over (partition by filing order by pos rows between current row and 19 following) as ahead from e),
s as (select filing, min(pos) as start from a where regexp_matches(text, '(?i)Item\\s+1\\.?\\s*Business') and ahead > 500 group by 1),
n as (select filing, min(pos) as end_ from a join s using (filing) where pos > start and regexp_matches(text, '(?i)^\\s*Item\\s+(1A\\.?\\s*(Risk|Unresolved)|2\\.?\\s*Propert)') group by 1)
select filing, count(*) as elements, sum(length(text))::bigint as chars from e join s using (filing) left join n using (filing) where pos >= start and pos < coalesce(end_, start + 1000) group by 1""",
        "T17_similar_articles": "select vec_id as article_id from embeddings a where not exists (select 1 from embeddings b where b.vec_id < a.vec_id and list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.95)",
        "T17_similar_texts": f"with {hashed_sql('select doc_id as article_id, text as x from documents where lang = ' + quote('en'), 'article_id', 256)}, v as (select article_id, vec, sqrt(list_dot_product(vec, vec)) as norm from hashed_article_id) select article_id from v a where not exists (select 1 from v b where b.article_id < a.article_id and b.norm > 0 and a.norm > 0 and list_dot_product(a.vec, b.vec) >= 0.95 * a.norm * b.norm)",
        "M1_hashed_vectors": f"with {hashed_sql('select doc_id as article_id, text as x from documents where lang = ' + quote('en'), 'article_id', 64)}, v as (select article_id, coalesce(list_transform(embedding::double[], lambda x: x / norm), vec) as vec from hashed_article_id left join (select vec_id as article_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings) using (article_id)) select article_id, round(vec[1], 6) as v0, round(vec[32], 6) as v31, round(vec[64], 6) as v63 from v",
        "J1_text_similarity": f"""with {firms}, {hashed_sql('select doc_id as article_id, text as x from documents where lang = ' + quote('en'), 'article_id', 256)}, {hashed_sql('select ticker, substr(combined_text, 1, 400) as x from companies', 'ticker', 256, 'idf_article_id')},
cells as (select label as topic_id, i, avg(vec[i]) as m from (select label, vec, unnest(range(1, 257)) as i from embeddings join hashed_article_id on vec_id = article_id semi join norms_article_id using (article_id)) group by 1, 2),
centres as (select topic_id, list(m order by i) as c, sqrt(sum(m * m)) as norm from cells group by 1)
select topic_id, ticker, round(list_dot_product(vec, c) / norm, 6) as sim from hashed_ticker, centres where list_dot_product(vec, c) / norm >= 0.3""",
        "M1_with_vectors": "select doc_id as article_id, md5(substr(text, 1, 400)) as key, round(embedding[1] / n, 6) as v0, round(embedding[64] / n, 6) as v63 from (select *, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) join documents on doc_id = vec_id where lang = 'en'",
        "M4_term_metrics": f"with {terms}, {words} select topic_id, term, round(cohesion, 6) as cohesion, round(centrality, 6) as centrality, round(niche, 6) as niche, round(share, 6) as share, generic from term_metrics",
        "M5_term_scores": f"with {terms}, {words} select topic_id, term, score from term_scores",
        "M6_filter_terms": f"with {terms}, {words} select topic_id, rank, term from filtered",
        "M7_apply_terms": f"with {terms}, {words} select topic_id, rank, term, weight from filtered where topic_id % 2 = 0 union all select topic_id, rank, term, weight from terms where topic_id not in (select topic_id from filtered where topic_id % 2 = 0)",
        "M9_domain_signals": f"""with {terms}, seen as (select label as topic_id, doc_id as article_id, array_to_string(list_filter({articles._sql_tokens('substr(text, 1, 50000)')}, lambda w: w not in ({generic})), ' ') as keywords, lower(substr(text, 1, 200)) as entities, row_number() over (partition by label order by doc_id) as seq from embeddings join documents on doc_id = vec_id where lang = 'en'),
heard as (select topic_id, list_sort(list_filter(list_distinct(flatten(list(string_split(entities, ' ')))), lambda w: length(w) > 2)) as entities, string_agg(keywords, ' ' order by seq) filter (seq <= 10) as said from seen where seq <= 15 group by 1)
select t.topic_id, array_to_string(any_value(technical), '|') as technical, md5(array_to_string(any_value(entities), '|')) as entities_md5, md5(lower(string_agg(term, ' ' order by rank) || ' ' || any_value(said))) as text_md5, string_agg(term, '|' order by rank) as keywords
from terms t left join technical using (topic_id) left join heard using (topic_id) group by 1""",
        "J6_J9_rejections": f"with {match} select topic_id, ticker, (({funds}) and mention < 0.2) or ((contains(combined_text, 'real estate investment trust') or contains(lower(name), 'reit')) and mention < 0.15 and nli < 0.3) as fund, (nli < 0.2 and kw < 0.1) as exits from decided",
        "J8_mention_score": f"with {near} select topic_id, ticker, count(*) as n_mentions, round(least(1, count(*) / 10), 6) as mention from first join valid using (article_id) where seq <= 15 group by 1, 2",
        "J12_mention_variants": f"with {low}, {ten} select topic_id, ticker, array_to_string(mentioned_as, '; ') as mentioned_as from variants10",
        "J15_depth_profiles": f"with {whole}, deep as (select sims.*, coalesce(len(list_filter(technical, lambda t: contains(own_text, t))) / nullif(len(technical), 0)::double, 0) as kw from sims left join technical using (topic_id)) {gates}",
        "S2_sample_companies": f"with {firms}, r as (select ticker, name, row_number() over (order by md5(ticker || '/3'), ticker) as n from companies where ticker not in ('THE', 'AND', 'NONE')), own as (select ticker, name from companies where ticker in ('THE', 'AND', 'NONE')) select ticker, name from r where n <= 60 - (select count(*) from own) or (select count(*) from own) >= 60 union all select ticker, name from own",
        "S6_cik_map": "select 'SYM' || (c_custkey % 40) as ticker, lpad(max(c_custkey)::varchar, 10, '0') as cik from customer where c_custkey % 7 <> 0 group by 1",
        "S8_report_text": f"with {rep} select {texts} from full_",
        "S9_read_report": f"with {rep} select * from full_",
        "S10_report_catalog": """with f as (select case o_orderkey % 3 when 0 then 'topic_companies_multitimeframe' when 1 then 'user7_topic_companies' else 'topics' end as base, (o_orderkey % 4 + 1)::int as depth, o_orderdate::date as d, o_orderkey % 24 as h, o_orderkey as length from orders where o_orderkey % 5 <> 0)
select base || '_depth-' || depth || '_' || strftime(d, '%m-%d-%Y') || '_' || lpad(h::varchar, 2, '0') || '.csv' as name, base, depth, d::timestamp + to_hours(h::bigint) as made_at, length from f where starts_with(base, 'topic')""",
        "S10_written_reports": """with d as (select max(l_shipdate::date) as d from lineitem), f as (select d::timestamp + to_hours(h) as made_at, depth from d, (values (5, 1), (30, 2), (6, 4)) v(h, depth))
select 'topic_companies_multitimeframe_depth-' || depth || '_' || strftime(made_at, '%m-%d-%Y_%H') || '.csv' as name, 'topic_companies_multitimeframe' as base, depth::int as depth, made_at from f""",
        "S12_merge_snapshots": f"""with {firms}, {phrases}, h as (select ticker, ('0x' || substr(md5(ticker), 1, 4))::bigint as h from companies), raw as (select numbered.ticker, n, name, text as description from numbered join companies using (ticker) join documents on doc_id = n where numbered.n % 5 <> 0 and trim(text) <> ''),
words as (select ticker, string_agg(phrase, ', ' order by rank) as whole, string_agg(phrase, ', ' order by rank) filter (rank <= 3) as three from keyed group by 1)
select raw.ticker as Ticker, raw.name as Name, md5(raw.description) as description_md5, coalesce(case when h % 7 = 0 or h % 2 = 0 then whole else three end, '') as Keywords, case when h % 7 = 0 then case when n % 2 = 0 then 'tools' else '' end else 'new' end as Sector, '' as Industry from raw join h using (ticker) left join words using (ticker)""",
        "R10_status_stream": articles.status_sql(),
        "J5_missing_pairs": f"with {match} select distinct desc_md5, hypothesis from gated join said using (topic_id) where (desc_md5, hypothesis) not in (select (desc_md5, hypothesis) from logits)",
        "J5_logit_cache": f"""with {match}, pairs_ as (select distinct desc_md5, hypothesis, ('0x' || substr(md5(desc_md5 || hypothesis), 1, 6))::bigint / 16777215.0::double * 8 - 7 as logit from gated join said using (topic_id)), half as (select * from pairs_ where desc_md5[1] in ('a', '3'))
select 1::int as run, count(*) as asked, count(*) as known, round(avg(logit), 6) as mean_logit from half
union all select 2::int, count(*) - (select count(*) from half), count(*), round(avg(logit), 6) from pairs_ union all select 3::int, 0, count(*), round(avg(logit), 6) from pairs_""",
        "S11_company_lookup": f"with {firms} select ticker, name from companies",
        "S12_assemble_companies": f"""with {firms}, {phrases}, raw as (select ticker, n, name, text_ as description from (select ticker, n, name, (select text from documents where doc_id = numbered.n) as text_ from named join numbered using (ticker, n) where ticker <> '') where n % 5 <> 0 and trim(text_) <> '')
select raw.ticker as Ticker, raw.name as Name, md5(raw.description) as description_md5, coalesce(k.keywords, '') as Keywords, case when raw.n % 2 = 0 then 'tools' else '' end as Sector, '' as Industry from raw left join (select ticker, string_agg(phrase, ', ' order by rank) as keywords from keyed group by 1) k using (ticker)""",
        "R3_report": f"with {rep} select * from full_",
        "R9_user_jobs": "select event_id as job_id, user_id, ts::timestamp as created_at from events where user_id = 7",
    }
