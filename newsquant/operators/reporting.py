"""Rankings, slices, searches and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import steps
from . import indicators, scores


def rank_by_style(df: DataFrame, top: int = 20) -> DataFrame:
    """Best ``top`` rows per topic and style, by relevance then score; ``missing`` counts rows without a score."""
    styles = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(f"{s}_score").alias("score"), F.col(f"{s}_rating").alias("rating")) for s in scores.STYLES]))
    rows = df.select("topic_id", "ticker", "relevance_score", styles.alias("s")).select("topic_id", "ticker", "relevance_score", "s.*")
    missing = rows.groupBy("topic_id", "style").agg(F.count_if(F.col("score").isNull()).alias("missing"))
    best = Window.partitionBy("topic_id", "style").orderBy(F.desc_nulls_last("relevance_score"), F.desc("score"), "ticker")
    ranked = rows.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(missing, ["topic_id", "style"])


def top_overall(df: DataFrame, style: str, top: int = 10) -> DataFrame:
    """Best ``top`` rows over all topics; relevance first where rows have one."""
    order = [F.desc_nulls_last("relevance_score")] if "relevance_score" in df.columns else []
    return df.where(F.col(f"{style}_score").isNotNull()).orderBy(*order, F.desc(f"{style}_score"), "ticker").limit(top)


def ticker_card(bars: DataFrame, fundamentals: DataFrame, symbol: str, day: DataFrame | None = None) -> DataFrame:
    """Metrics and scores of one symbol, in any case; empty without data."""
    own = lambda df: df.where(F.upper("ticker") == symbol.upper())
    return scores.score_all(indicators.stock_metrics(own(bars), own(fundamentals), day))


def slice_report(report: DataFrame, style: str, topic: int | None = None) -> DataFrame:
    """Rows of a topic (or all), best score of ``style`` first, unknown scores last."""
    rows = report if topic is None else report.where(F.col("topic_id") == topic)
    return rows.orderBy(F.desc_nulls_last(f"{style}_score"), "ticker")


def topic_summary(report: DataFrame) -> DataFrame:
    return report.where("topic_id is not null").groupBy("topic_id").agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("companies"))


def search_companies(companies: DataFrame, report: DataFrame, text: str, top: int = 15) -> DataFrame:
    """Tickers and names that contain ``text``: exact, then prefix, then alphabetical; one row per ticker.

    Price and day change come from the ``report(ticker, name, current_price, change_1d)`` rows of a
    ticker, the smallest where there are several; report rows whose ticker is no company's are found too.
    """
    q = text.lower()
    hit = lambda df: df.where(F.contains(F.lower("ticker"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q)))
    priced = report.groupBy("ticker").agg(F.min(F.struct("name", "current_price", "change_1d")).alias("row"))
    first = hit(companies).groupBy("ticker").agg(F.min("name").alias("name"))
    more = hit(report).select("ticker").distinct().join(first, "ticker", "left_anti").select("ticker", F.lit(None).cast("string").alias("name"))
    place = F.when(F.lower("ticker") == q, 0).when(F.startswith(F.lower("ticker"), F.lit(q)), 1).otherwise(2)
    found = first.unionByName(more).withColumn("place", place).orderBy("place", "ticker").limit(top)
    return found.join(priced, "ticker", "left").select("ticker", F.coalesce("name", "row.name").alias("name"), "place", "row.current_price", "row.change_1d").orderBy("place", "ticker")


#: Words of a rating text and their colour, tried in this order.
SIGNALS = (("STRONG BUY", "emerald"), ("BUY", "green"), ("BULLISH", "blue"), ("UPTREND", "blue"), ("HOLD", "amber"), ("CONSOLIDATING", "amber"), ("SELL", "red"), ("AVOID", "red"), ("DOWNTREND", "red"), ("CAUTION", "orange"), ("MIXED", "orange"))


def signal_class(rating: Column) -> Column:
    """Colour class of a rating text; texts without a known word are slate."""
    return steps([(F.contains(F.upper(rating), F.lit(word)), colour) for word, colour in SIGNALS], "slate")


def score_band(score: Column) -> Column:
    """Colour band of a score; zero and unknown are slate."""
    return steps([(score.isNull() | (score == 0), "slate"), (score >= 0.7, "emerald"), (score >= 0.5, "cyan"), (score >= 0.3, "amber")], "red")


def report_catalog(files: DataFrame) -> DataFrame:
    """``(path, length)`` of report files -> name, base, depth, timestamp, length; other names are left out, newest first.

    Parts of a report that Spark wrote, ``<report>/part-...``, are one file.
    """
    parted = F.col("path").rlike(r"/part-[^/]*$")
    whole = files.where(parted).groupBy(F.regexp_replace("path", r"/part-[^/]*$", "").alias("path")).agg(F.sum("length").alias("length"))
    files = files.where(~parted).select("path", "length").unionByName(whole)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pattern = r"^(topic.*)_depth-(\d+)_(\d{2}-\d{2}-\d{4}_\d{2})\.csv$"
    rows = files.withColumn("name", name).where(F.col("name").rlike(pattern))
    part = lambda i: F.regexp_extract("name", pattern, i)
    return rows.select("name", part(1).alias("base"), part(2).cast("int").alias("depth"), F.to_timestamp(part(3), "MM-dd-yyyy_HH").alias("made_at"), "length").orderBy(F.desc("made_at"), "name")


def resolve_queries(jobs: DataFrame, presets: DataFrame) -> DataFrame:
    """``(job_id, query)``: a job's own trimmed queries, preset keys replaced by their text."""
    asked = jobs.select("job_id", F.explode("queries").alias("asked")).select("job_id", F.trim("asked").alias("asked")).where("asked <> ''")
    out = asked.join(F.broadcast(presets), F.col("asked") == F.col("key"), "left")
    return out.select("job_id", F.coalesce("query", "asked").alias("query"))


def user_jobs(jobs: DataFrame, user: int) -> DataFrame:
    return jobs.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "job_id")


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per job of ``(job_id, ts, status, result, error)``, streamed or not, with its last error.

    ``completed_at`` and ``result`` are those of a job whose last status is completed. Of events at one
    time the greatest status counts.
    """
    known = F.when(F.coalesce("error", F.lit("")) != "", F.struct("ts", "error"))
    out = events.groupBy("job_id").agg(F.max(F.struct("ts", "status", "result")).alias("last"), F.max(known).alias("wrong"), F.count("*").alias("changes"))
    done = lambda c: F.when(F.col("last.status") == "completed", F.col(f"last.{c}"))
    return out.select("job_id", F.col("last.status").alias("status"), F.col("last.ts").alias("updated_at"), done("ts").alias("completed_at"), done("result").alias("result"), F.col("wrong.error").alias("last_error"), "changes")


def job_stats(jobs: DataFrame) -> DataFrame:
    """Counts by status over all jobs."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "running", "failed", "pending")])


#: Report columns, their source and how they are written: decimals, or none as it is; ``blank`` leaves zero out, ``share`` is in percent.
REPORT = (
    ("Topic_ID", "topic_id", None, ""), ("Topic_Keywords", "topic_keywords", None, ""), ("Ticker", "ticker", None, ""), ("Company_Name", "name", None, ""), ("Relevance_Score", "relevance_score", 3, ""), ("Mentions", "n_mentions", None, ""),
    ("Mentioned_As", "mentioned_as", None, "list"), ("Day_Trade_Score", "day_score", None, ""), ("Day_Trade_Rating", "day_rating", None, ""), ("Swing_Trade_Score", "swing_score", None, ""), ("Swing_Trade_Rating", "swing_rating", None, ""),
    ("Position_Trade_Score", "position_score", None, ""), ("Position_Trade_Rating", "position_rating", None, ""), ("LongTerm_Score", "longterm_score", None, ""), ("LongTerm_Rating", "longterm_rating", None, ""),
    ("Current_Price", "current_price", 2, ""), ("Change_1D", "change_1d", 2, ""), ("Change_1W", "change_1w", 2, ""), ("Change_1M", "change_1m", 2, ""), ("Change_3M", "change_3m", 2, ""), ("Change_1Y", "change_1y", 2, ""),
    ("Volume_Spike_Ratio", "volume_spike_ratio", 2, ""), ("RSI_14", "rsi_14", 1, ""), ("Price_vs_MA50", "price_vs_ma50", 2, ""), ("Price_vs_MA200", "price_vs_ma200", 2, ""), ("PE_Ratio", "pe_ratio", 2, "blank"), ("PEG_Ratio", "peg_ratio", 2, "blank"),
    ("Dividend_Yield", "dividend_yield", 2, "blank"), ("Profit_Margin", "profit_margin", 2, "share"), ("ROE", "roe", 2, "share"),
)


def report_rows(rows: DataFrame) -> DataFrame:
    """The 30 report columns, one row per topic and company; numbers stay numbers, zero fundamentals are blank."""
    out = []
    for name, source, decimals, how in REPORT:
        x = F.col(source)
        if how == "list":
            x = F.when(F.col("n_mentions") > 0, F.coalesce(F.array_join(x, "; "), F.lit(""))).otherwise("")
        elif how:
            x = F.when(x != 0, x * 100 if how == "share" else x)
        out.append((x if decimals is None else F.round(x, decimals)).alias(name))
    return rows.select(*out)


def report_text(report: DataFrame) -> DataFrame:
    """Report rows as the file shows them: fixed decimals, unknown values empty."""
    shown = [F.col(n) if d is None else F.when(F.col(n).isNull(), "").otherwise(F.format_string(f"%.{d}f", F.col(n).cast("double"))).alias(n) for n, _, d, _ in REPORT]
    return report.select(*shown)
