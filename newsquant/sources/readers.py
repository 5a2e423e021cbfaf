"""Sources and the cleaning that belongs to reading."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a CSV with a header: names trimmed, rows with ticker and name, search text added."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)
    return clean_companies(raw.toDF(*[c.strip() for c in raw.columns]))


def clean_companies(raw: DataFrame) -> DataFrame:
    """Trim ``Ticker, Name, Description, Keywords``; drop rows without ticker or name."""
    own = {c.lower(): F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("Ticker", "Name", "Description", "Keywords")}
    out = raw.select(*[v.alias(k) for k, v in own.items()]).where("ticker <> '' and name <> ''")
    return out.withColumns({"name_lower": F.lower("name"), "ticker_lower": F.lower("ticker"), "combined_text": F.lower(F.concat_ws(" ", "name", "description", "keywords"))})


def company_lookup(companies: DataFrame) -> DataFrame:
    return companies.select("ticker", "name")


def recent_bars(bars: DataFrame, days: int = 30) -> DataFrame:
    """Bars of symbols that traded within ``days`` of the last date."""
    last = bars.agg(F.max("bar_date").alias("as_of"))
    recent = bars.join(F.broadcast(last), F.col("bar_date") >= F.date_sub("as_of", days)).select("ticker").distinct()
    return bars.join(recent, "ticker", "left_semi")


def _number(name: str) -> Column:
    x = F.trim(F.col(name))
    return F.when(~F.upper(x).isin("N/A", "", "NONE"), x.try_cast("double"))


def clean_fundamentals(raw: DataFrame) -> DataFrame:
    """Text fundamentals as nullable doubles; zero stands for missing where one value backs another."""
    either = lambda a, b: F.coalesce(F.nullif(_number(a), F.lit(0.0)), _number(b))
    income = _number("dividend")
    return raw.select(
        "ticker",
        either("trailing_pe", "forward_pe").alias("pe_ratio"), _number("forward_pe").alias("forward_pe"), _number("peg").alias("peg_ratio"), _number("price_to_book").alias("price_to_book"),
        _number("margin").alias("profit_margin"), _number("return_on_equity").alias("roe"), _number("debt").alias("debt_to_equity"), _number("revenue").alias("revenue_growth"),
        either("earnings", "earnings_quarter").alias("earnings_growth"), F.coalesce(_number("market_cap"), F.lit(0.0)).alias("market_cap"), F.when(income > 0, income * 100).otherwise(0.0).alias("dividend_yield"),
    )


def merge_tickers(*frames: DataFrame) -> DataFrame:
    """Distinct trimmed, non-blank symbols of several lists, sorted."""
    out = frames[0].select("ticker")
    for more in frames[1:]:
        out = out.unionByName(more.select("ticker"))
    return out.select(F.trim("ticker").alias("ticker")).where("ticker <> ''").distinct().orderBy("ticker")


def parse_cik_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, line)`` of tab-split ticker and number: two parts only, last line wins, padded to 10."""
    parts = F.split("line", "\t")
    out = lines.where(F.size(parts) == 2).select("line_no", F.upper(F.trim(parts[0])).alias("ticker"), F.lpad(F.trim(parts[1]), 10, "0").alias("cik"))
    return out.groupBy("ticker").agg(F.max_by("cik", "line_no").alias("cik"))


def read_cik_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_cik_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))


def sample_companies(companies: DataFrame, n: int, forced: list[str], seed: int = 0) -> DataFrame:
    """Rows of forced tickers and, by a repeatable hash order, others up to ``n`` rows in all.

    All others stay where they fit, and also where the forced rows alone reach ``n``.
    """
    own = F.coalesce(F.col("ticker").isin(forced), F.lit(False))
    left = n - companies.where(own).count()
    rest = companies.where(~own)
    if left > 0:
        rest = rest.orderBy(F.md5(F.concat("ticker", F.lit(f"/{seed}"))), "ticker").limit(left)
    return companies.where(own).unionByName(rest)


def assemble_companies(raw: DataFrame, keywords: DataFrame) -> DataFrame:
    """Company records from profile rows ``(ticker, longName, shortName, longBusinessSummary, sector, industry)``.

    ``keywords(ticker, phrase, rank)`` are joined by commas; profiles without a description go.
    """
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    empty = F.lit("")
    own = raw.where(known("longBusinessSummary").isNotNull())
    listed = keywords.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]), ", ").alias("Keywords"))
    return own.join(listed, "ticker", "left").select(
        F.col("ticker").alias("Ticker"), F.coalesce(known("longName"), known("shortName"), empty).alias("Name"), F.col("longBusinessSummary").alias("Description"),
        F.coalesce("Keywords", empty).alias("Keywords"), F.coalesce("sector", empty).alias("Sector"), F.coalesce("industry", empty).alias("Industry"),
    )


def merge_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Company records of two snapshots, one row per ticker: what the new one knows counts, else the old.

    Keywords are those of the newest description: a new row without one keeps the old keywords, a
    ticker of one snapshot only keeps its row. Tickers should be unique in each.
    """
    columns = ("Name", "Description", "Keywords", "Sector", "Industry")
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    a, b = (df.select(F.col("Ticker"), *[F.col(c).alias(f"{x}_{c}") for c in columns]) for df, x in ((old, "old"), (new, "new")))
    rows = a.join(b, "Ticker", "full_outer")
    pick = lambda c: F.coalesce(known(f"new_{c}"), F.col(f"old_{c}"), F.lit(""))
    words = F.when(known("new_Description").isNotNull(), F.coalesce("new_Keywords", F.lit(""))).otherwise(F.coalesce("old_Keywords", "new_Keywords", F.lit("")))
    return rows.select("Ticker", *[(words if c == "Keywords" else pick(c)).alias(c) for c in columns])


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table of snapshots, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version that :func:`update_companies` wrote to ``path``."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def update_companies(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Merge company records into the snapshot at ``path`` and return the new one.

    Each run writes a version of its own, which counts once it is complete; readers see the old rows until then.
    """
    old, number = read_snapshot(spark, path), (_versions(spark, path) or [0])[-1] + 1
    merged = merge_companies(old if old is not None else new.limit(0), new)
    merged.write.mode("overwrite").parquet(f"{path}/v={number}")
    return read_snapshot(spark, path)


def report_name(depth: int, made_at: datetime, user: str | None = None, base: str = "topic_companies_multitimeframe") -> str:
    """Name of a report: user if there is one, what it holds, search depth, day and hour."""
    return f"{f'{user}_' if user else ''}{base}_depth-{depth}_{made_at:%m-%d-%Y_%H}.csv"


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write report rows as CSV or Parquet, topic by topic, best relevance first."""
    rows = report.repartitionByRange("Topic_ID").sortWithinPartitions("Topic_ID", F.desc("Relevance_Score"), "Ticker")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def write_named_report(report: DataFrame, folder: str, depth: int, made_at: datetime, user: str | None = None) -> str:
    """Write report rows as CSV under their name in ``folder``; returns the path."""
    path = f"{folder}/{report_name(depth, made_at, user)}"
    write_report(report, path)
    return path


def list_files(spark: SparkSession, folder: str, names: str = "*.csv") -> DataFrame:
    """``(path, length)`` of the files below ``folder``; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder).select("path", "length")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV report by its schema, without empty lines."""
    rows = spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)
    return rows.where(F.col("Topic_ID").isNotNull())
