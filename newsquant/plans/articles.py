"""Queries over articles, topics, companies and jobs; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import BOILERPLATE, COMMON_WORDS, FUND_MARKS, GENERIC_TERMS, SHORT_WORDS, STOP_WORDS
from ..operators import matching, mentions, reporting, selection, text, topics
from ..sources import files, fixtures, readers
from . import stocks
from .shared import once

Query = Callable[[SparkSession, str], DataFrame]
PROFILE = matching.DepthProfile.of(1)
SUFFIXES = ("Inc", "Corp.", "", "Etf", "Ltd")
QUERIES = ((0, ("rewh", "The of")), (1, ("ononst", "hehely", "in the", "and")), (2, ("zzzz",)))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select(F.col("doc_id").alias("article_id"), F.col("text").alias("fulltext"), F.col("source").alias("link"))


@once
def _raw_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a company: its number's document gives symbol, name, description and keywords."""
    number = F.col("s_suppkey")
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s_suppkey"), "text")
    rows = fixtures.table(spark, sf_dir, "supplier").select("s_suppkey").join(docs, "s_suppkey")
    # four words are asked for, and only the first piece before them can be empty: the sixth is the rest of the text
    pieces = F.slice(F.split(F.lower("text"), "[^a-z]+", 6), 1, 5)
    rows = rows.withColumn("w", F.filter(pieces, lambda w: w != "")).where(F.size("w") >= 4)
    first = lambda i: F.concat(F.upper(F.substring(F.get("w", F.lit(i)), 1, 1)), F.expr(f"substring(get(w, {i}), 2)"))
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (number % len(SUFFIXES)).cast("int"))
    rows = rows.select(
        number.alias("n"), F.when(number % 17 == 0, "").otherwise(F.upper(F.substring(F.get("w", F.lit(1)), 1, 5))).alias("Ticker"),
        F.concat(F.lit(" "), first(2), F.lit(" "), first(3), F.lit(" "), suffix, F.lit(" ")).alias("Name"), F.col("text").alias("Description"), F.concat_ws(", ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("Keywords"),
    )
    return rows.groupBy("Ticker").agg(F.min_by(F.struct("Name", "Description", "Keywords"), "n").alias("c"), F.min("n").alias("n")).select("Ticker", "c.*", "n")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.clean_companies(_raw_companies(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("label").alias("topic_id"), F.col("embedding").alias("vec"))


def _topic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("article_id", "topic_id").join(_articles(spark, sf_dir), "article_id")


@once
def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_terms(_topic_articles(spark, sf_dir))


@once
def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_centroids(_members(spark, sf_dir))


@once
def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies with the vector of their number; ``own_text`` is what entailment, and the signals beside it, read."""
    known = _raw_companies(spark, sf_dir).select(F.col("Ticker").alias("ticker"), F.col("n").alias("article_id"))
    out = _companies(spark, sf_dir).join(known, "ticker").join(_members(spark, sf_dir).select("article_id", "vec"), "article_id")
    brand = F.concat(F.lit("Brand#"), (F.col("article_id") % 5 + 1).cast("string"), (F.floor(F.col("article_id") / 5) % 6 + 1).cast("string"))
    own = F.substring("combined_text", 1, 400)
    return out.select("ticker", "name", "combined_text", own.alias("own_text"), "vec", text.content_key(own, 1).alias("desc_md5"), brand.alias("symbol"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English articles as the mention search reads them, other scripts blanked."""
    return _articles(spark, sf_dir).select("article_id", F.regexp_replace("fulltext", r"[^\x00-\x7F]", " ").alias("body"))


@once
def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and the articles that they have."""
    return _members(spark, sf_dir).select("topic_id", "article_id").join(_articles(spark, sf_dir).select("article_id"), "article_id", "left_semi")


def _topic_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles of each topic, the first 10,000 characters of their bodies, and the companies."""
    bodies = _bodies(spark, sf_dir).withColumn("body", F.substring("body", 1, 10_000))
    return _placed(spark, sf_dir), bodies, _companies(spark, sf_dir).select("ticker", "name")


@once
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their centroids and technical terms."""
    return _centroids(spark, sf_dir).join(topics.technical_terms(_terms(spark, sf_dir)), "topic_id", "left")


def _candidates(spark: SparkSession, sf_dir: str, least: float = PROFILE.min_similarity, read: str = "own_text") -> DataFrame:
    """Pairs of topics and companies that are alike enough, and the share of the topic's terms in the company's column ``read``."""
    # terms come with the topics, so that no text travels with a pair
    pairs = matching.similarity_join(_firms(spark, sf_dir), _classes(spark, sf_dir), least)
    return pairs.withColumn("kw", matching.share_contained("technical", F.col(read))).withColumnRenamed("technical", "entities")


@once
def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.stage1_gate(_candidates(spark, sf_dir), PROFILE)


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.hypotheses(_terms(spark, sf_dir), PROFILE.hypotheses)


def _logits(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """A logit table from hash digits, without every seventh."""
    keys = pairs.select("desc_md5", "topic_id").join(said, "topic_id").select("desc_md5", "hypothesis").distinct()
    digits = F.conv(F.substring(F.md5(F.concat("desc_md5", "hypothesis")), 1, 6), 16, 10).cast("long")
    return keys.withColumn("d", digits).where("d % 7 <> 0").select("desc_md5", "hypothesis", (F.col("d") / 16777215.0 * 8 - 7).alias("logit"))


def _entailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, said = _gated(spark, sf_dir), _said(spark, sf_dir)
    return matching.entailment(pairs, said, _logits(pairs, said))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = matching.entity_score(_entailed(spark, sf_dir), "own_text")
    said = mentions.mention_score(*_topic_bodies(spark, sf_dir))
    signals = signals.join(said, ["topic_id", "ticker"], "left").fillna(0, ["n_mentions", "mention"])
    return matching.relevance(signals, PROFILE)


def _scored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _decided(spark, sf_dir).where("relevant")
    return matching.final_score(kept).withColumn("relevance_score", F.round("relevance_score", 6))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.adaptive_top_n(_scored_matches(spark, sf_dir))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _matched(spark, sf_dir).withColumnRenamed("ticker", "company").withColumnRenamed("symbol", "ticker")
    return matching.attach_scores(out, stocks._scored(spark, sf_dir))


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).select("topic_id", "company", "ticker", "relevance_score", F.round("swing_score", 6).alias("swing_score"), "swing_rating")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), "event_id")
    named = lambda s, what: F.when(F.col("status") == s, F.concat(F.lit(f"{what} "), F.col("event_id").cast("string")))
    return rows.select("job_id", "ts", "status", named("completed", "report").alias("result"), named("failed", "fault").alias("error"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the last three quarters of the time in which one comes out every hour."""
    asked = spark.createDataFrame([(i, list(a)) for i, a in QUERIES], "query_id int, alternatives array<string>")
    hour = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("article_id").cast("int"))
    rows = files.saved(_bodies(spark, sf_dir).withColumn("date", hour), "dated")
    last = rows.agg(F.max("article_id")).first()[0] or 0
    at = lambda hours: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
    return selection.select_articles(rows, asked, at(last // 4), at(last))


def _vectors_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _centroids(spark, sf_dir)
    return out.select("topic_id", *[F.round(F.get("centroid", F.lit(i)), 6).alias(f"c{i}") for i in (0, 1, 31, 63)])


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and customers; balances stand for prices, of companies too where a customer has their number."""
    rows = fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("current_price"), (F.col("c_nationkey") / 10).alias("change_1d"))
    own = _raw_companies(spark, sf_dir).where("Ticker <> ''").select(F.col("Ticker").alias("ticker"), F.col("n").alias("c_custkey"))
    named = rows.join(own, "c_custkey", "left").select(F.coalesce("ticker", F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("name"), "current_price", "change_1d")
    return reporting.search_companies(_companies(spark, sf_dir), named, "On", 15)


def queries() -> dict[str, Query]:
    return {
        "S1_read_companies": lambda s, d: _companies(s, d),
        "S3_select_articles": _selected,
        "S7_merge_tickers": lambda s, d: readers.merge_tickers(fixtures.table(s, d, "part").select(F.concat(F.lit(" "), "p_brand").alias("ticker")), fixtures.table(s, d, "nation").select(F.col("n_name").alias("ticker"))),
        "T1_clean_text": lambda s, d: _articles(s, d).select("article_id", text.clean_text(F.col("fulltext")).alias("cleaned")),
        "T4_boosted_document": lambda s, d: _articles(s, d).select("article_id", text.boosted_document(F.col("fulltext"), F.substring("fulltext", 1, 12), F.col("link")).alias("boosted")),
        "T5_length_gate": lambda s, d: text.length_gate(_articles(s, d)).select("article_id", F.length("fulltext").alias("chars")),
        "T7_company_variants": lambda s, d: text.company_variants(_companies(s, d)),
        "T15_dedup_paragraphs": lambda s, d: text.dedup_paragraphs(_paragraphs(s, d)).select("doc", F.md5("section").alias("section_md5"), F.length("section").alias("chars")),
        "T18_content_key": lambda s, d: _articles(s, d).select("article_id", text.content_key(F.col("fulltext"), 2).alias("key2"), text.content_key(F.col("fulltext"), 3).alias("key3")),
        "M2_assign_topics": lambda s, d: topics.assign_topics(_members(s, d).select("article_id", "topic_id"), 48),
        "M3_topic_terms": lambda s, d: _terms(s, d),
        "M8_topic_centroids": _vectors_digest,
        "M9_technical_terms": lambda s, d: topics.technical_terms(_terms(s, d)).select("topic_id", F.array_join("technical", "|").alias("technical")),
        "J1_similarity_join": lambda s, d: matching.similarity_join(_firms(s, d), _centroids(s, d), PROFILE.min_similarity).select("topic_id", "ticker", F.round("sim", 6).alias("sim")),
        "J2_keyword_score": lambda s, d: _candidates(s, d, read="combined_text").select("topic_id", "ticker", F.round("kw", 6).alias("kw")),
        "J3_stage1_gate": lambda s, d: matching.stage1_gate(_candidates(s, d, read="combined_text"), PROFILE).select("topic_id", "ticker", F.round("sim", 6).alias("sim")),
        "J4_hypotheses": _said,
        "J5_entailment": lambda s, d: _entailed(s, d).select("topic_id", "ticker", F.round("nli", 6).alias("nli")),
        "J10_relevance": lambda s, d: _decided(s, d).select("topic_id", "ticker", F.round("total", 6).alias("total"), "relevant"),
        "J13_adaptive_top_n": lambda s, d: _matched(s, d).select("topic_id", "ticker", "relevance_score", "rank"),
        "J14_attach_scores": _report_rows,
        "R4_slice_report": lambda s, d: reporting.slice_report(_report_rows(s, d), "swing", 1),
        "R5_topic_summary": lambda s, d: reporting.topic_summary(_report_rows(s, d)),
        "R6_search_companies": _searched,
        "R8_signal_class": lambda s, d: stocks._scored(s, d).select("ticker", reporting.signal_class(F.col("swing_rating")).alias("signal"), reporting.score_band(F.round("swing_score", 6)).alias("band")),
        "R9_job_stats": lambda s, d: reporting.job_stats(_jobs(s, d)),
        "R10_latest_status": lambda s, d: reporting.latest_status(_jobs(s, d)),
    }


def _texts(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def _sql_tokens(x: str) -> str:
    return f"list_filter(string_split(lower(regexp_replace(regexp_replace({x}, 'http\\S+', '', 'g'), '[^a-zA-Z ]', ' ', 'g')), ' '), lambda w: length(w) > 2 and not list_contains([{_texts(STOP_WORDS | BOILERPLATE)}], w))"


def companies_sql() -> str:
    suffix = " ".join(f"when {i} then '{s}'" for i, s in enumerate(SUFFIXES))
    init = lambda i: f"upper(w[{i}][1:1]) || w[{i}][2:]"
    return f"""named as (select s_suppkey as n, case when s_suppkey % 17 = 0 then '' else upper(substr(w[2], 1, 5)) end as ticker, trim({init(3)} || ' ' || {init(4)} || ' ' || case s_suppkey % {len(SUFFIXES)} {suffix} end) as name, trim(text) as description, w[1] || ', ' || w[2] as keywords
  from (select s_suppkey, text, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as w from supplier join documents on doc_id = s_suppkey) where len(w) >= 4),
numbered as (select ticker, min(n) as n from named group by 1),
companies as (select ticker, name, description, keywords, lower(name || ' ' || description || ' ' || keywords) as combined_text from named join numbered using (ticker, n) where ticker <> '' and name <> '')"""


def variants_sql() -> str:
    suffixes = r"\b(inc\.?|corp\.?|corporation|company|ltd\.?|limited|llc|plc)\b"
    return rf"""spelt as (select ticker, lower(ticker) as t, lower(name) as n, trim(regexp_replace(lower(name), '{suffixes}', '', 'g')) as bare,
  lower(array_to_string(list_transform(list_filter(string_split_regex(name, '\s+'), lambda w: regexp_matches(w, '^[A-Z]') or length(w) > 3), lambda w: substr(w, 1, 1)), '')) as acro, len(string_split_regex(name, '\s+')) as words from companies),
lists as (select ticker, case when length(t) = 1 then [n] || (case when length(bare) >= 3 then [bare] else [] end) when length(t) = 2 and t in ({_texts(SHORT_WORDS)}) then [n]
  else [t, '$' || t, n] || (case when length(bare) >= 3 then [bare] else [] end) || (case when words >= 2 and length(acro) >= 3 and acro not in ({_texts(COMMON_WORDS)}) then [acro] else [] end)
    || (case when length(t) >= 4 then list_transform(range(2, length(t) - 1), lambda i: substr(t, 1, i) || ' ' || substr(t, i + 1)) else [] end) end as vs from spelt),
variants as (select ticker, unnest(list_distinct(vs)) as variant from lists)"""


def status_sql() -> str:
    return """with jobs as (select event_id, user_id as job_id, ts, case event_type when 'signup' then 'pending' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status from events),
last_ as (select job_id, ts, status, event_id, row_number() over (partition by job_id order by ts desc, status desc, case when status = 'completed' then 'report ' || event_id end desc nulls last) as n, count(*) over (partition by job_id) as changes from jobs),
wrong as (select job_id, 'fault ' || event_id as last_error from (select *, row_number() over (partition by job_id order by ts desc, 'fault ' || event_id desc) as n from jobs where status = 'failed') where n = 1)
select job_id, status, ts as updated_at, case when status = 'completed' then ts end as completed_at, case when status = 'completed' then 'report ' || event_id end as result, last_error, changes from last_ left join wrong using (job_id) where n = 1"""


def mentions_sql(articles: str, body: str, most: int = 10_000) -> str:
    """Common table expressions from ``art``, ``first`` and ``companies`` to ``counted``, ``valid``, over the first ``most`` characters."""
    words = " or ".join(f"contains(near, '{w}')" for w in mentions.STOCK_WORDS)
    contexts = " or ".join("regexp_matches(near, " + " || lower(ticker) || ".join("'" + x.replace("'", "''") + "'" for x in c.split("T")) + ")" for c in mentions.CONTEXTS)
    around = lambda before, after, n: f"substr(body, greatest(1, p - {before})::bigint, (p + {n} + {after} - greatest(1, p - {before}))::bigint)"
    return rf"""{variants_sql()},
art as (select doc_id as article_id, substr(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), 1, {most}) as body from documents where lang = 'en'),
first as (select topic_id, article_id, row_number() over (partition by topic_id order by article_id) as seq from (select label as topic_id, vec_id as article_id from embeddings) semi join art using (article_id)),
asked as (select article_id, {body} as body from {articles}),
kept as (select * from variants where length(variant) >= 2 and (length(variant) > 2 or starts_with(variant, '$')) and not (length(variant) <= 3 and variant in ({_texts(COMMON_WORDS | SHORT_WORDS)}))),
both_ as (select * from asked, kept where contains(lower(body), variant)),
spots as (select article_id, ticker, variant, {around(50, 50, 3)} as near, {around(10, 2, 3)} as tight, substr(body, greatest(1, p - 5)::bigint, (p - greatest(1, p - 5))::bigint) as ahead
  from (select *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 3 + 1)::bigint as p from (select *, unnest(range(1, len(parts))) as i from (select *, string_split(lower(body), variant) as parts from both_ where length(variant) = 3 and not starts_with(variant, '$') and not contains(variant, ' '))))
  where not regexp_matches(substr(lower(body), p + 3, 1), '[a-z]') and (p = 1 or not regexp_matches(substr(lower(body), p - 1, 1), '[a-z]'))),
counts_ as (select article_id, ticker, variant, count(*) as n from spots where {words} or contains(ahead, '$') or regexp_matches(tight, '(ticker|symbol|code)[:\s]' || variant) or contains(tight, '(' || variant || ')') group by 1, 2, 3
  union all select article_id, ticker, variant, len(regexp_extract_all(regexp_replace(lower(body), '([^a-z])', '\1\1', 'g'), '[^a-z]' || regexp_escape(variant) || '[^a-z]')) from both_ where length(variant) <= 3 and starts_with(variant, '$')
  union all select article_id, ticker, variant, len(regexp_extract_all(lower(body), '\b' || regexp_escape(variant) || '\b')) from both_ where length(variant) > 3 or contains(variant, ' ')),
counted as (select article_id, ticker, sum(n)::bigint as mentions, list_sort(list(variant || ' (' || n || 'x)')) as mentioned_as from counts_ where n > 0 group by 1, 2),
places as (select *, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(ticker) + 1)::bigint as p from (select *, unnest(range(1, len(parts))) as i from (select article_id, ticker, name, body, string_split(lower(body), lower(ticker)) as parts from counted join asked using (article_id) join companies using (ticker)))),
tickers as (select article_id, ticker, name, substr(body, p, length(ticker)) as own, lower({around(100, 100, 'length(ticker)')}) as near from places where not regexp_matches(substr(body, p + length(ticker), 1), '\w') and (p = 1 or not regexp_matches(substr(body, p - 1, 1), '\w'))),
valid as (select distinct article_id, ticker from tickers where case when length(ticker) <= 4 then ({contexts} or list_bool_or(list_transform(list_filter(string_split_regex(lower(name), '\s+'), lambda w: length(w) > 3)[1:2], lambda w: contains(near, w))))
  else regexp_matches(own, '^[A-Z]') or (upper(own) = own and lower(own) <> own) end)"""


def oracle_sql() -> dict[str, str]:
    articles = "articles as (select doc_id as article_id, text as fulltext, source as link from documents where lang = 'en')"
    companies = companies_sql()
    grams = " union all ".join(f"select topic_id, array_to_string(tokens[i:i + {n - 1}], ' ') as term from (select topic_id, tokens, unnest(range(1, len(tokens) - {n - 2})) as i from tok where len(tokens) >= {n})" for n in (1, 2, 3))
    terms = f"""{articles}, members as (select vec_id as article_id, label as topic_id, embedding as vec from embeddings),
tok as (select topic_id, {_sql_tokens('fulltext')} as tokens from members join articles using (article_id)),
counts as (select topic_id, term, count(*) as tf from ({grams}) group by 1, 2),
classes as (select topic_id, sum(tf)::bigint as class_total from counts group by 1), totals as (select term, sum(tf)::bigint as f from counts group by 1),
weighted as (select topic_id, term, round(tf / class_total::double * ln(1 + (select avg(class_total) from classes) / f), 9) as weight from counts join totals using (term) join classes using (topic_id)),
terms as (select topic_id, rank, term, weight from (select *, row_number() over (partition by topic_id order by weight desc, term)::int as rank from weighted) where rank <= 8),
technical as (select topic_id, list_sort(list(distinct lower(term))) as technical from terms where length(term) > 3 and lower(term) not in ({_texts(GENERIC_TERMS)}) group by 1)"""
    match = f"""{terms},
cells as (select topic_id, i, avg(vec[i]::double) as m from (select topic_id, vec, unnest(range(1, len(vec) + 1)) as i from members) group by 1, 2),
centroids as (select topic_id, list(m / norm order by i) as centroid from (select *, sqrt(sum(m * m) over (partition by topic_id)) as norm from cells) group by 1),
{companies},
firms as (select ticker, name, combined_text, substr(combined_text, 1, 400) as own_text, embedding as vec, md5(substr(substr(combined_text, 1, 400), 1, 200)) as desc_md5, 'Brand#' || (vec_id % 5 + 1) || (vec_id // 5 % 6 + 1) as symbol from companies join numbered using (ticker) join embeddings on vec_id = n),
sims as (select topic_id, ticker, name, combined_text, own_text, desc_md5, symbol, list_dot_product(vec::double[], centroid) as sim from firms, centroids),
cand as (select sims.*, technical, coalesce(len(list_filter(technical, lambda t: contains(own_text, t))) / nullif(len(technical), 0)::double, 0) as kw from sims left join technical using (topic_id) where sim >= 0.05),
gated as (select * from cand where kw >= 0.05 or sim >= 0.15),
said as (select topic_id, 'This company ' || verb || ' ' || term || '.' as hypothesis from terms, (values ('works with'), ('specializes in')) v(verb) where rank <= 4),
logits as (select desc_md5, hypothesis, d / 16777215.0::double * 8 - 7 as logit from (select distinct desc_md5, hypothesis, ('0x' || substr(md5(desc_md5 || hypothesis), 1, 6))::bigint as d from gated join said using (topic_id)) where d % 7 <> 0),
best as (select topic_id, ticker, max(1 / (1 + exp(-logit))) as nli from gated join said using (topic_id) join logits using (desc_md5, hypothesis) group by 1, 2),
{mentions_sql("(select article_id, body from art semi join (select article_id from first where seq <= 15) using (article_id))", "body")},
said15 as (select topic_id, ticker, count(*) as n_mentions from first join valid using (article_id) where seq <= 15 group by 1, 2),
entailed as (select gated.*, coalesce(nli, 0) as nli, coalesce(len(list_filter(technical, lambda t: contains(own_text, t) or contains(lower(ticker), t))) / nullif(len(technical), 0)::double, 0) as entity,
  coalesce(n_mentions, 0) as n_mentions, least(1, coalesce(n_mentions, 0) / 10) as mention from gated left join best using (topic_id, ticker) left join said15 using (topic_id, ticker)),
decided as (select *, nli * 0.65 + kw * 0.15 + mention * 0.10 + entity * 0.10 as total,
  (nli * 0.65 + kw * 0.15 + mention * 0.10 + entity * 0.10 >= 0.15 or (nli >= 0.3 and kw >= 0.15) or mention >= 0.2 or nli >= 0.4) and not ((nli < 0.2 and kw < 0.1) or (({' or '.join(f"contains(lower(name), '{m}')" for m in FUND_MARKS)}) and mention < 0.2)
    or ((contains(combined_text, 'real estate investment trust') or contains(lower(name), 'reit')) and mention < 0.15 and nli < 0.3)) as relevant from entailed),
ranked as (select *, row_number() over (partition by topic_id order by relevance_score desc, ticker)::int as rank from (select *, round(sim + nli * 0.3 + kw * 0.2 + least(0.15, n_mentions * 0.04), 6) as relevance_score from decided where relevant)),
edged as (select *, min(case when rank > 10 and relevance_score < edge - 0.15 then rank end) over (partition by topic_id) as cut from (select *, max(case when rank = 10 then relevance_score end) over (partition by topic_id) as edge from ranked where rank <= 50)),
matched as (select * from edged where cut is null or rank < cut)"""
    whole = match.replace("substr(combined_text, 1, 400) as own_text", "combined_text as own_text")
    report = f"{match}, {stocks._sql_metrics()}, {stocks._sql_scores()}, report as (select topic_id, m.ticker as company, symbol as ticker, relevance_score, round(swing_score, 6) as swing_score, swing_rating from matched m left join rated r on r.ticker = symbol)"
    jobs = "jobs as (select user_id as job_id, ts, case event_type when 'signup' then 'pending' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status from events)"
    hits = " union all ".join(f"select {i}::int as query_id, article_id, (" + " + ".join(f"len(regexp_extract_all(body, '\\b{a.lower()}\\b'))" for a in alts) + ")::bigint as hits from dated" for i, alts in QUERIES)
    dated = r"dated as (select doc_id as article_id, lower(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')) as body from documents where lang = 'en' and length(text) > 300 and timestamp '2024-01-01' + to_hours(doc_id) >= timestamp '2024-01-01' + to_hours((select max(doc_id) // 4 from documents where lang = 'en')))"
    swing = "".join(f" when contains(swing_rating, '{w}') then '{c}'" for w, c in reporting.SIGNALS)
    return {
        "S1_read_companies": f"with {companies} select ticker, name, description, keywords, lower(name) as name_lower, lower(ticker) as ticker_lower, combined_text from companies",
        "S3_select_articles": f"with {dated} select * from (select *, row_number() over (partition by query_id order by hits desc, article_id)::int as place from ({hits}) where hits > 0) where place <= 100",
        "S7_merge_tickers": "select p_brand as ticker from part union select n_name from nation",
        "T1_clean_text": f"with {articles} select article_id, array_to_string({_sql_tokens('fulltext')}, ' ') as cleaned from articles",
        "T4_boosted_document": f"with {articles}, b as (select article_id, fulltext || ' ' || repeat(substr(fulltext, 1, 12), 3) || ' ' || repeat(link, 2) as x from articles) select article_id, array_to_string({_sql_tokens('x')}, ' ') as boosted from b",
        "T5_length_gate": f"with {articles} select article_id, least(length(fulltext), 50000)::int as chars from articles where length(fulltext) > 300",
        "T7_company_variants": f"with {companies}, {variants_sql()} select ticker, variant from variants",
        "T15_dedup_paragraphs": """with e as (select doc_id as doc, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
f as (select doc, trim(text) as text, min(pos) as pos from e where length(trim(text)) > 10 and not regexp_matches(trim(text), '^[0-9]+$') group by 1, 2),
j as (select doc, substr(trim(regexp_replace(string_agg(text, ' ' order by pos), '\\s+', ' ', 'g')), 1, 500000) as section from f group by 1)
select doc, md5(section) as section_md5, length(section)::int as chars from j""",
        "T18_content_key": f"with {articles} select article_id, md5(substr(fulltext, 1, 200)) as key2, md5(substr(fulltext, 1, 300)) as key3 from articles",
        "M2_assign_topics": "select vec_id as article_id, case when count(*) over (partition by label) < 48 then -1 else label end as topic_id from embeddings",
        "M3_topic_terms": f"with {terms} select * from terms",
        "M8_topic_centroids": f"with {match} select topic_id, round(centroid[1], 6) as c0, round(centroid[2], 6) as c1, round(centroid[32], 6) as c31, round(centroid[64], 6) as c63 from centroids",
        "M9_technical_terms": f"with {terms} select topic_id, array_to_string(technical, '|') as technical from technical",
        "J1_similarity_join": f"with {match} select topic_id, ticker, round(sim, 6) as sim from sims where sim >= 0.05",
        "J2_keyword_score": f"with {whole} select topic_id, ticker, round(kw, 6) as kw from cand",
        "J3_stage1_gate": f"with {whole} select topic_id, ticker, round(sim, 6) as sim from gated",
        "J4_hypotheses": f"with {match} select topic_id, hypothesis from said",
        "J5_entailment": f"with {match} select topic_id, ticker, round(nli, 6) as nli from entailed",
        "J10_relevance": f"with {match} select topic_id, ticker, round(total, 6) as total, relevant from decided",
        "J13_adaptive_top_n": f"with {match} select topic_id, ticker, relevance_score, rank from matched",
        "J14_attach_scores": f"with {report} select * from report",
        "R4_slice_report": f"with {report} select * from report where topic_id = 1",
        "R5_topic_summary": f"with {report} select topic_id, count(*) as rows, count(distinct ticker) as companies from report group by 1",
        "R6_search_companies": f"""with {companies}, rep as (select coalesce(ticker, c_custkey::varchar) as ticker, c_name as name, c_acctbal as current_price, c_nationkey / 10 as change_1d from customer left join (select ticker, n from numbered where ticker <> '') on n = c_custkey),
hits as (select ticker, name from companies where contains(lower(ticker), 'on') or contains(lower(name), 'on') union select ticker, name from rep where (contains(lower(ticker), 'on') or contains(lower(name), 'on')) and ticker not in (select ticker from companies where contains(lower(ticker), 'on') or contains(lower(name), 'on')))
select h.ticker, h.name, case when lower(h.ticker) = 'on' then 0 when starts_with(lower(h.ticker), 'on') then 1 else 2 end as place, current_price, change_1d from hits h left join rep using (ticker) order by place, h.ticker limit 15""",
        "R8_signal_class": f"with {stocks._sql_metrics()}, {stocks._sql_scores()} select ticker, case{swing} else 'slate' end as signal, case when coalesce(round(swing_score, 6), 0) = 0 then 'slate' when round(swing_score, 6) >= 0.7 then 'emerald' when round(swing_score, 6) >= 0.5 then 'cyan' when round(swing_score, 6) >= 0.3 then 'amber' else 'red' end as band from rated",
        "R9_job_stats": f"with {jobs} select count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'running') as running, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'pending') as pending from jobs",
        "R10_latest_status": status_sql(),
    }
