"""Mentions of companies in articles: an index of word places, phrases by places, contexts by ranges of places.

Words are runs of letters. The index holds a row for each word of each article that some spelling has:
its number in the article, its place, the next word, and what stands around both. Spellings of
several words are found by their pairs of neighbours, of which an article has no more than words.
Bodies are read twice at most: to be indexed, and once an article for the characters around its hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from unicodedata import category

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import COMMON_WORDS, SHORT_WORDS
from ..sources import files
from .text import company_variants

#: Words near a three-letter symbol that make it a stock.
STOCK_WORDS = "stock shares ticker nasdaq nyse trading market corporation inc company corp limited ltd price earnings revenue valuation ipo traded".split()
#: Contexts in which a symbol of up to four letters is a company; ``T`` stands for the symbol.
CONTEXTS = (
    r"\b(inc\.|incorporated|corp\.|corporation|ltd\.|limited|llc|plc)\b", r"\b(T's|T's)\b", r"\$T\b", r"\b(ceo|cfo|president|chairman|founder|executive)\b.*\bT\b",
    r"\bT\b.*(announced|reported|said|stated|revealed|disclosed|launched|released)", r"\b(shares|stock|ticker|symbol)\b.*\bT\b", r"\bT\b.*(shares|stock|trading|investors)",
    r"\b(nasdaq|nyse|exchange|traded)\b.*\bT\b", r"\bT\b.*(ipo|offering|acquisition|merger|earnings|revenue)",
)


#: What a text without any of cannot fit a context: their words, and what stands beside the symbol.
KEYS = tuple(sorted({word.replace("\\", "").lstrip("T") for c in CONTEXTS for group in re.findall(r"\(([^)]*)\)", c) for word in group.split("|")} | {"$"}))
#: What stands for the symbol, as a word of its own, in a text that contexts are searched in.
MARK = "\u0001"
#: Longest text between two words that the index keeps; longer ones never match.
GAP = 64
_RUN = re.compile("[A-Za-z]+")


def word_index(articles: DataFrame) -> DataFrame:
    """``(article_id, ord, token, start, before, first, after, last, next, beyond, ends)`` of every run of letters of ``articles(article_id, body)``.

    ``start`` counts from 1; ``before`` and ``after`` are the other characters up to the neighbours, ``GAP`` and
    one at most. ``next`` is the word behind, ``beyond`` and ``ends`` are what ``after`` and ``last`` are there.
    """

    import pyarrow as pa

    names = ("article_id", "ord", "token", "start", "before", "first", "after", "last", "next", "beyond", "ends")
    schema = T.StructType([articles.schema["article_id"]]).add("ord", "integer").add("token", "string").add("start", "integer")
    for name, kind in (("before", "string"), ("first", "boolean"), ("after", "string"), ("last", "boolean"), ("next", "string"), ("beyond", "string"), ("ends", "boolean")):
        schema = schema.add(name, kind)
    kinds = {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}
    types = [pa.int64(), *[kinds[f.dataType.typeName()] for f in schema.fields[1:]]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def part(held: list[list]) -> pa.RecordBatch:
                at, *rest = (pa.array(x, kind) for x, kind in zip(held, types))
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), *rest], list(names))

            held: list[list] = [[] for _ in names]
            for at, body in enumerate(batch.column(1)):
                body = body.as_py() or ""
                words, gaps = _RUN.findall(body), _RUN.split(body)
                n, place, starts = len(words), 1, []
                if not n:
                    continue
                for gap, word in zip(gaps, words):
                    place += len(gap)
                    starts.append(place)
                    place += len(word)
                tokens, before, behind = [w.lower() for w in words], [g[-GAP - 1 :] for g in gaps[:-1]], [g[: GAP + 1] for g in gaps[1:]]
                only = lambda i: [j == i for j in range(n)]
                own = ([at] * n, range(n), tokens, starts, before, only(0), behind, only(n - 1), tokens[1:] + [None], behind[1:] + [None], only(n - 2))
                for column, values in zip(held, own):
                    column.extend(values)
                if len(held[0]) > 100_000:
                    yield part(held)
                    held = [[] for _ in names]
            if held[0]:
                yield part(held)

    return articles.select("article_id", "body").mapInArrow(cut, schema)


def _is_word(char: Column) -> Column:
    """Whether a character is one of a word; none is not."""
    return F.coalesce(F.rlike(char, F.lit(r"(?U)\w")), F.lit(False))


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(article_id, ticker, phrase, start)`` of the hits of lower-cased ``phrases(ticker, phrase, tight)`` in an index.

    A tight phrase needs no letter beside it, another a word boundary at both ends. Phrases without
    letters are never found. A phrase of several words is looked up by the rarest of its pairs of
    neighbours, with the text between them.
    """
    own = phrases.distinct().withColumns({"runs": F.regexp_extract_all("phrase", F.lit("[a-z]+"), F.lit(0)), "gaps": F.split("phrase", "[a-z]+", -1)}).where(F.size("runs") > 0)
    own = files.saved(own, "phrases")  # few, and their size is known so
    cols, pair = ["article_id", "ticker", "phrase", "tight", "gaps"], ["token", "after", "next"]
    first, last, beyond = F.struct("start", "before", "first").alias("head"), F.struct("after", "last").alias("tail"), F.struct(F.col("beyond").alias("after"), F.col("ends").alias("last")).alias("tail")
    single = index.join(own.where(F.size("runs") == 1).withColumn("token", F.get("runs", F.lit(0))), "token").select(*cols, first, last)
    several = own.where(F.size("runs") > 1)
    at = lambda i: F.struct(i.alias("i"), F.get("runs", i).alias("token"), F.get("gaps", i + 1).alias("after"), F.get("runs", i + 1).alias("next"))
    pairs = lambda: F.inline(F.transform(F.sequence(F.lit(0), F.size("runs") - 2), at))
    links = several.select("ticker", "phrase", pairs())
    met = files.saved(index.join(links.where(F.length("after") <= GAP).select(*pair).distinct(), pair, "left_semi").select("article_id", "ord", *pair, "start", "before", "first", "beyond", "ends"), "pairs")
    rare = F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "i", *pair)).alias("rare")
    anchors = links.join(met.groupBy(*pair).agg(F.count("*").alias("many")), pair, "left").groupBy("ticker", "phrase").agg(rare).where("rare.many > 0")
    anchored = files.saved(several.join(anchors.select("ticker", "phrase", "rare.i", *[f"rare.{c}" for c in pair]), ["ticker", "phrase"]), "anchors")
    double = met.join(anchored.where(F.size("runs") == 2), pair).select(*cols, first, beyond)
    # other pairs at their own numbers
    found = met.select("article_id", "ord", *pair).join(anchored.where(F.size("runs") > 2), pair).withColumn("base", F.col("ord") - F.col("i"))
    asked = found.select(*cols, "base", (F.size("runs") - 1).alias("m"), pairs()).withColumn("ord", F.col("base") + F.col("i"))
    placed = asked.join(met, ["article_id", "ord", *pair])
    joined = placed.groupBy(*cols, "base", "m").agg(F.count("*").alias("n"), F.max(F.when(F.col("i") == 0, first)).alias("head"), F.max(F.when(F.col("i") == F.col("m") - 1, beyond)).alias("tail"))
    hits = single.unionByName(double).unionByName(joined.where("n = m").select(*cols, "head", "tail"))
    # the phrase's own first and last characters, and the characters beside them
    lead, rest = F.get("gaps", F.lit(0)), F.element_at("gaps", -1)
    left = F.when(F.length("head.before") > F.length(lead), F.substring(F.col("head.before"), F.length("head.before") - F.length(lead), F.lit(1))).when(~F.col("head.first"), "a")
    right = F.when(F.length("tail.after") > F.length(rest), F.substring(F.col("tail.after"), F.length(rest) + 1, F.lit(1))).when(~F.col("tail.last"), "a")
    fits = F.endswith(F.col("head.before"), lead) & F.startswith(F.col("tail.after"), rest)
    bare = ~F.coalesce(left.rlike("[A-Za-z]"), F.lit(False)) & ~F.coalesce(right.rlike("[A-Za-z]"), F.lit(False))
    edges = (_is_word(left) != _is_word(F.substring("phrase", 1, 1))) & (_is_word(right) != _is_word(F.substring("phrase", -1, 1)))
    kept = hits.where(fits & F.when(F.col("tight"), bare).otherwise(edges))
    return kept.select("article_id", "ticker", "phrase", (F.col("head.start") - F.length(lead)).alias("start"))


def _around(text: Column, at: Column, before: int, length: Column, after: int) -> Column:
    """``text`` from ``before`` characters ahead of a hit to ``after`` characters behind it."""
    start = F.greatest(at - before, F.lit(1))
    return F.substring(text, start, at + length + after - start)


def with_surroundings(hits: DataFrame, articles: DataFrame, parts: dict[str, tuple[int, int | None]]) -> DataFrame:
    """``hits(article_id, phrase, start, ...)`` with the texts ``parts``, each so far before and behind the hit (None: not the hit either).

    An article's hits come together, so its body is read once and never copied.
    """
    own = [c for c in hits.columns if c != "article_id"]
    listed = hits.groupBy("article_id").agg(F.collect_list(F.struct(*own)).alias("hits"))
    cut = lambda h: F.struct(*[h[c].alias(c) for c in own], *[_around(F.col("body"), h["start"], a, F.length(h["phrase"]) if b is not None else F.lit(0), b or 0).alias(k) for k, (a, b) in parts.items()])
    return listed.join(articles.select("article_id", "body"), "article_id").select("article_id", F.inline(F.transform("hits", cut)))


def is_stock() -> Column:
    """Whether a three-letter symbol with ``near``, ``tight`` and ``ahead`` around it is meant as a stock."""
    known = F.lit(False)
    for word in STOCK_WORDS:
        known = known | F.contains("near", F.lit(word))
    tight = F.regexp_replace("tight", r"\s", " ")
    for word in ("ticker", "symbol", "code"):
        for sign in (":", " "):
            known = known | F.contains(tight, F.concat(F.lit(f"{word}{sign}"), "phrase"))
    return known | F.contains("ahead", F.lit("$")) | F.contains(tight, F.concat(F.lit("("), "phrase", F.lit(")")))


def count_mentions(articles: DataFrame, companies: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(article_id, ticker, mentions, mentioned_as)`` of ``articles(article_id, body)`` that name a company.

    Hits of one spelling that overlap count once. ``index`` may be one of :func:`saved_index`.
    """
    phrases = spellings(companies)
    index = saved_index(articles, phrases) if index is None else index
    hits = files.saved(phrase_hits(index, phrases), "hits")  # symbols and other spellings go different ways
    size = F.length("phrase")
    symbol = (size <= 3) & ~F.contains("phrase", F.lit(" ")) & ~F.startswith("phrase", F.lit("$"))
    checked = with_surroundings(hits.where(symbol), articles, {"near": (50, 50), "tight": (10, 2), "ahead": (5, None)}).where(is_stock())
    hits = hits.where(~symbol).unionByName(checked.select(*hits.columns))
    listed = hits.groupBy("article_id", "ticker", "phrase").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    step = lambda acc, at: F.when(at >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (at + F.length("phrase")).alias("free"))).otherwise(acc)
    apart = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")), step, lambda acc: acc["n"])
    said = F.concat("phrase", F.lit(" ("), apart.cast("string"), F.lit("x)"))
    found = listed.select("article_id", "ticker", apart.cast("long").alias("n"), said.alias("said"))
    return found.groupBy("article_id", "ticker").agg(F.sum("n").alias("mentions"), F.array_sort(F.collect_set("said")).alias("mentioned_as"))


def spellings(companies: DataFrame) -> DataFrame:
    """``(ticker, phrase, tight)``: the spellings that are searched for; short common words are not."""
    own = F.col("variant")
    common = own.isin(*sorted(COMMON_WORDS | SHORT_WORDS))
    rows = company_variants(companies).where((F.length(own) >= 2) & ((F.length(own) > 2) | F.startswith(own, F.lit("$"))) & ~((F.length(own) <= 3) & common))
    return rows.select("ticker", own.alias("phrase"), ((F.length(own) <= 3) & ~F.contains(own, F.lit(" "))).alias("tight"))


def symbols(companies: DataFrame) -> DataFrame:
    """``(ticker, phrase, tight)``: tickers as words of their own."""
    return companies.select("ticker", F.lower("ticker").alias("phrase"), F.lit(False).alias("tight"))


def saved_index(articles: DataFrame, *phrases: DataFrame) -> DataFrame:
    """The index of ``articles``, of words that a phrase has, written once as it is read several times."""
    words = None
    for more in phrases:
        own = more.select(F.explode(F.regexp_extract_all("phrase", F.lit("[a-z]+"), F.lit(0))).alias("token"))
        words = own if words is None else words.unionByName(own)
    return files.saved(word_index(articles).join(files.saved(words.distinct(), "tokens"), "token", "left_semi"), "words")


def _likely_word(ticker: str) -> bool:
    """Whether a symbol may be a common word: up to four capitals."""
    return len(ticker) <= 4 and ticker.upper() == ticker and not re.search("[0-9]", ticker) and re.search("[A-Z]", ticker) is not None


def _key_places(low: str) -> list[int]:
    """Sorted places of what every context needs one of."""
    places = []
    for key in KEYS:
        at = low.find(key)
        while at >= 0:
            places.append(at)
            at = low.find(key, at + 1)
    return sorted(places)


def company_pairs(articles: DataFrame) -> DataFrame:
    """``(article_id, ticker)`` of ``articles(article_id, body, asked)`` that have a hit where a company would stand.

    ``asked`` are structs ``(ticker, name, starts)``. Symbols of up to four capitals need a business context or
    a word of the name within 100 characters of a hit; others need a hit in capitals or with a first one.
    Patterns are tried only around hits that have a context's word near, and only up to the first that fits.
    """
    import pyarrow as pa

    marked = {c: c.replace(r"\bT\b", MARK).replace(r"\b(T's|T's)\b", rf"{MARK}'s\b").replace(r"\$T\b", rf"\${MARK}") for c in CONTEXTS}
    # contexts that do not name the symbol are searched in the text as it is
    plain, about = ([re.compile(m) for c, m in marked.items() if (m == c) == same] for same in (True, False))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str | None], tuple] = {}

        def of(ticker: str, name: str | None) -> tuple:
            """Whether the symbol may be a word, words of the name, and the symbol's pattern."""
            held = known.get((ticker, name))
            if held is None:
                if len(known) >= 100_000:
                    known.clear()
                words = [w for w in re.split(r"\s+", (name or "").lower(), flags=re.ASCII) if len(w) > 3][:2]
                held = known[ticker, name] = (_likely_word(ticker), words, re.compile(rf"\b{re.escape(ticker.lower())}\b"))
            return held

        def stands(body: str, places: list[int], ticker: str, name: str | None, starts) -> bool:
            word, words, own = of(ticker, name)
            size = len(ticker.lower())
            for start in starts:
                at = int(start) - 1
                if not word:
                    hit = body[at : at + size]
                    if category(hit[0]) == "Lu" or (hit.upper() == hit and hit.lower() != hit):
                        return True
                    continue
                first, last = max(at - 100, 0), at + size + 100
                k = bisect_left(places, first)
                keyed = k < len(places) and places[k] < last
                if not (keyed or words):
                    continue
                near = body[first:last].lower()
                if any(w in near for w in words):
                    return True
                if keyed:
                    said = own.sub(MARK, near)
                    if any(p.search(near) for p in plain) or any(p.search(said) for p in about):
                        return True
            return False

        for batch in batches:
            bodies, asked = batch.column(1), batch.column(2)
            ends, rows = asked.offsets.to_numpy(), asked.values
            tickers, names, starts = rows.field(0).to_pylist(), rows.field(1).to_pylist(), rows.field(2)
            bounds, values = starts.offsets.to_numpy(), starts.values.to_numpy()
            at, found = [], []
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                low = body.lower()
                # where lower case has another length, places would not agree: patterns are tried everywhere
                places = _key_places(low) if len(low) == len(body) else list(range(len(body)))
                for j in range(ends[i], ends[i + 1]):
                    if stands(body, places, tickers[j], names[j], values[bounds[j] : bounds[j + 1]]):
                        at.append(i)
                        found.append(tickers[j])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["article_id", "ticker"])

    schema = T.StructType([articles.schema["article_id"]]).add("ticker", "string")
    return articles.select("article_id", "body", "asked").mapInArrow(find, schema)


def validate_mentions(counted: DataFrame, articles: DataFrame, companies: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add ``valid`` to ``counted(article_id, ticker, ...)``: whether one hit of the symbol stands where a company would."""
    index = saved_index(articles, symbols(companies)) if index is None else index
    asked = counted.select("article_id", "ticker").distinct()
    hits = phrase_hits(index, symbols(companies)).join(asked, ["article_id", "ticker"], "left_semi")
    each = hits.groupBy("article_id", "ticker").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    named = each.join(companies.select("ticker", "name"), "ticker")  # the name travels to the texts, not the texts to it
    listed = named.groupBy("article_id").agg(F.collect_list(F.struct("ticker", "name", "starts")).alias("asked"))
    good = company_pairs(listed.join(articles.select("article_id", "body"), "article_id")).distinct().withColumn("_good", F.lit(True))
    return counted.join(good, ["article_id", "ticker"], "left").withColumn("valid", F.coalesce("_good", F.lit(False))).drop("_good")


def first_articles(members: DataFrame, n: int) -> DataFrame:
    """The first ``n`` articles of each topic of ``members(topic_id, article_id)``."""
    order = Window.partitionBy("topic_id").orderBy("article_id")
    return members.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= n)


def mention_score(members: DataFrame, articles: DataFrame, companies: DataFrame) -> DataFrame:
    """``(topic_id, ticker, n_mentions, mention)``: articles among a topic's first 15 with a valid mention; others have no row."""
    first = first_articles(members, 15)
    own = files.saved(articles.join(first.select("article_id").distinct(), "article_id", "left_semi"), "bodies")
    index = saved_index(own, spellings(companies), symbols(companies))
    valid = validate_mentions(count_mentions(own, companies, index), own, companies, index).where("valid").select("article_id", "ticker")
    counts = first.join(valid, "article_id").groupBy("topic_id", "ticker").agg(F.count("*").alias("n_mentions"))
    return counts.withColumn("mention", F.least(F.lit(1.0), F.col("n_mentions") / 10))


def mention_variants(members: DataFrame, articles: DataFrame, companies: DataFrame) -> DataFrame:
    """``(topic_id, ticker, mentioned_as)``: spellings found in a topic's first 10 articles, lower-cased."""
    first = first_articles(members, 10)
    own = files.saved(articles.join(first.select("article_id").distinct(), "article_id", "left_semi").withColumn("body", F.lower("body")), "bodies")
    said = first.join(count_mentions(own, companies), "article_id").select("topic_id", "ticker", F.explode("mentioned_as").alias("said"))
    return said.groupBy("topic_id", "ticker").agg(F.array_sort(F.collect_set("said")).alias("mentioned_as"))
