"""Text preparation: cleaning, gates, variants, keys, paragraphs, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import BOILERPLATE, COMMON_WORDS, GENERIC_NOUNS, PHRASE_EXACT, PHRASE_FIRST, PHRASE_LAST, PHRASE_PARTS, PHRASE_STOPS, SHORT_WORDS, STOP_WORDS, SUFFIXES


def clean_tokens(text: Column) -> Column:
    """Lower-case letter words of more than two letters, without links, stop words and page furniture."""
    # runs are replaced at once, as a replacement a character takes most of the time; empty words go below
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"http\S+", ""), "[^a-zA-Z]+", " "))
    drop = sorted(STOP_WORDS | BOILERPLATE)  # as isin a set to look up, not a list to walk through
    return F.filter(F.split(bare, " "), lambda w: (F.length(w) > 2) & ~w.isin(*drop))


def clean_text(text: Column) -> Column:
    return F.array_join(clean_tokens(text), " ")


def boosted_document(text: Column, keywords: Column, entities: Column) -> Column:
    """Cleaned text with keywords three times and entities twice, repeated without a separator."""
    own = lambda x: F.coalesce(x, F.lit(""))
    return clean_text(F.concat(own(text), F.lit(" "), F.repeat(own(keywords), 3), F.lit(" "), F.repeat(own(entities), 2)))


def length_gate(df: DataFrame, text: str = "fulltext", low: int = 300, cut: int = 50_000) -> DataFrame:
    """Bodies cut to ``cut`` characters; those of ``low`` or fewer go."""
    return df.withColumn(text, F.substring(text, 1, cut)).where(F.length(text) > low)


def content_key(text: Column, depth: int) -> Column:
    return F.md5(F.substring(text, 1, 200 if depth <= 2 else 300))


def company_variants(companies: DataFrame) -> DataFrame:
    """``(ticker, variant)``: spellings under which a company may be named."""
    ticker, name = F.lower("ticker"), F.lower("name")
    bare = F.trim(F.regexp_replace(name, SUFFIXES, ""))
    bare_list = F.when(F.length(bare) >= 3, F.array(bare)).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    first = F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]") | (F.length(w) > 3)), lambda w: F.substring(w, 1, 1))
    acronym = F.lower(F.array_join(first, ""))
    known = F.array(*[F.lit(w) for w in sorted(COMMON_WORDS)])
    acronyms = F.when((F.size(words) >= 2) & (F.length(acronym) >= 3) & ~F.array_contains(known, acronym), F.array(acronym)).otherwise(F.array().cast("array<string>"))
    n = F.length(ticker)
    cuts = F.when(n >= 4, F.transform(F.sequence(F.lit(2), n - 2), lambda i: F.concat(F.substring(ticker, F.lit(1), i), F.lit(" "), F.substring(ticker, i + 1, n)))).otherwise(F.array().cast("array<string>"))
    full = F.concat(F.array(ticker, F.concat(F.lit("$"), ticker), name), bare_list, acronyms, cuts)
    short = F.array(*[F.lit(w) for w in sorted(SHORT_WORDS)])
    chosen = F.when(n == 1, F.concat(F.array(name), bare_list)).when((n == 2) & F.array_contains(short, ticker), F.array(name)).otherwise(full)
    return companies.select("ticker", F.explode(F.array_distinct(chosen)).alias("variant"))


def clean_description(description: Column, name: Column) -> Column:
    """A description without its company's longer name words and without boilerplate sentences."""
    long_words = F.filter(F.split(name, " "), lambda w: F.length(w) > 4)
    out = F.aggregate(long_words, description, lambda text, w: F.regexp_replace(text, F.concat(F.lit(r"(?i)\b\Q"), w, F.lit(r"\E\b")), F.lit("")))
    for pattern in (r"The company was formerly known as[^.]*\.", r"formerly known as[^.]*\.", r"headquartered in[^.]*\.", r"based in \w+, \w+\.", r"founded in \d{4}[^.]*\."):
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return out


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by one space."""
    def runs_of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]))
        return F.when(F.size(tokens) >= n, each).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(low, high + 1)]
    return F.concat(*runs)


def dedup_paragraphs(elements: DataFrame) -> DataFrame:
    """``(doc, pos, text)`` -> ``(doc, section)``: first occurrence of each paragraph over ten characters that is not a number."""
    own = elements.select("doc", "pos", F.trim("text").alias("text")).where((F.length("text") > 10) & ~F.col("text").rlike("^[0-9]+$"))
    first = own.groupBy("doc", "text").agg(F.min("pos").alias("pos"))
    joined = first.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), r"\s+", " "))
    return joined.select("doc", F.substring(text, 1, 500_000).alias("section"))


def latest_filing(filings: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of ``form`` in each company's parallel arrays, with its path."""
    each = F.posexplode(F.arrays_zip("form", "accession", "document"))
    rows = filings.select("cik", each.alias("pos", "f")).where(F.col("f.form") == form)
    best = rows.groupBy("cik").agg(F.min_by("f", "pos").alias("f"))
    return best.select("cik", F.concat_ws("/", "cik", F.replace(F.col("f.accession"), F.lit("-"), F.lit("")), F.col("f.document")).alias("path"))


def extract_section(elements: DataFrame, reach: int = 1000) -> DataFrame:
    """Elements ``(filing, pos, text)`` of the business section: from its heading that has text below to the next item."""
    ahead = Window.partitionBy("filing").orderBy("pos").rowsBetween(0, 19)
    rows = elements.withColumn("ahead", F.sum(F.length("text")).over(ahead))
    start = rows.where(F.col("text").rlike(r"(?i)Item\s+1\.?\s*Business") & (F.col("ahead") > 500)).groupBy("filing").agg(F.min("pos").alias("start"))
    ends = rows.where(F.col("text").rlike(r"(?i)^\s*Item\s+(1A\.?\s*(Risk|Unresolved)|2\.?\s*Propert)")).select("filing", "pos").join(start, "filing").where("pos > start")
    end = ends.groupBy("filing").agg(F.min("pos").alias("end"))
    bounds = start.join(end, "filing", "left").withColumn("end", F.coalesce("end", F.col("start") + reach))
    return elements.join(bounds, "filing").where("pos >= start and pos < end").select("filing", "pos", "text")


def extract_keywords(df: DataFrame, text: str = "fulltext", lexicon: DataFrame | None = None, kinds: tuple[str, ...] = ("NOUN", "PROPN"), cut: int = 50_000) -> DataFrame:
    """Add ``keywords``: the cleaned words of a text's first ``cut`` characters, repeats included, without generic nouns.

    With ``lexicon(token, pos, lemma)`` only words of ``kinds`` stay, as their lemmas; a word with several
    entries gives its smallest lemma. Rows need not have a key.
    """
    tokens = clean_tokens(F.substring(text, 1, cut))
    generic = sorted(GENERIC_NOUNS)
    if lexicon is None:
        return df.withColumn("keywords", F.array_join(F.filter(tokens, lambda w: ~w.isin(*generic)), " "))
    known = lexicon.where(F.col("pos").isin(*kinds)).groupBy("token").agg(F.min(F.lower("lemma")).alias("_lemma")).where(~F.col("_lemma").isin(*generic))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    places = rows.select("_row", F.posexplode(tokens).alias("_at", "token")).join(known, "token")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_lemma"))), lambda w: w["_lemma"]), " ")
    words = places.groupBy("_row").agg(joined.alias("keywords"))
    return rows.join(words, "_row", "left").withColumn("keywords", F.coalesce("keywords", F.lit(""))).drop("_row")


def tag_entities(articles: DataFrame, gazetteer: DataFrame, labels: tuple[str, ...] = ("ORG", "GPE", "PRODUCT"), high: int = 3) -> DataFrame:
    """``(article_id, entities, hits)``: runs of one to ``high`` words that ``gazetteer(surface, label)`` lists under ``labels``."""
    known = gazetteer.where(F.col("label").isin(*labels)).select("surface").distinct()
    # runs are counted per article before they shuffle
    tokens = articles.select("article_id", clean_tokens(F.col("fulltext")).alias("tokens"))
    runs = tokens.select("article_id", F.explode(ngrams(F.col("tokens"), 1, high)).alias("surface"))
    hits = runs.groupBy("article_id", "surface").agg(F.count("*").alias("n")).join(known, "surface")
    return hits.groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("surface")), " ").alias("entities"), F.sum("n").alias("hits"))


def enrich_descriptions(companies: DataFrame, numbers: DataFrame, sections: DataFrame) -> DataFrame:
    """``description`` followed by the filing section of the company's number, where there is one."""
    out = companies.join(numbers, "ticker", "left").join(sections, "cik", "left")
    return out.withColumn("description", F.when(F.col("section").isNotNull(), F.concat_ws(" ", "description", "section")).otherwise(F.col("description"))).select(*companies.columns)


def drop_repeats(articles: DataFrame, text: str = "fulltext") -> DataFrame:
    """Articles without later ones of the same text, case and white space aside."""
    key = F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))))
    first = articles.groupBy(key.alias("_key")).agg(F.min("article_id").alias("article_id"))
    return articles.join(first.select("article_id"), "article_id", "left_semi")


def company_keywords(companies: DataFrame, top: int = 12) -> DataFrame:
    """``(ticker, phrase, score, rank)``: the ``top`` phrases of each description by share of all phrases times words.

    Phrases are runs of two to four words inside a sentence, stop words and short words left out.
    """
    said = companies.select("ticker", F.lower("name").alias("name"), F.explode(F.split(F.lower("description"), r"[.!?\n]+")).alias("sentence"))
    tokens = F.filter(F.split("sentence", "[^a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(PHRASE_STOPS)))
    rows = said.select("ticker", "name", F.explode(ngrams(tokens, 2, 4)).alias("phrase"))
    words = F.split("phrase", " ")
    bad = F.col("phrase").isin(*PHRASE_EXACT) | F.exists(F.array(*[F.lit(b) for b in PHRASE_PARTS]), lambda b: F.contains("phrase", b)) | F.exists(words, lambda w: F.contains("name", w))
    rows = rows.where(~bad & ~F.get(words, F.lit(0)).isin(*PHRASE_FIRST) & ~F.element_at(words, -1).isin(*PHRASE_LAST))
    counts = rows.groupBy("ticker", "phrase").agg(F.count("*").alias("n"))
    totals = counts.groupBy("ticker").agg(F.sum("n").alias("total"))
    scored = counts.join(totals, "ticker").withColumn("score", F.col("n") / F.col("total") * F.size(F.split("phrase", " ")))
    best = Window.partitionBy("ticker").orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("ticker", "phrase", "score", "rank")
