"""Input views that the library's queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: exact decimal sums, one division, no rounding."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    money, pieces = (F.sum(F.col(x).cast("decimal(18,2)")).cast("double") for x in ("l_extendedprice", "l_quantity"))
    out = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    return out.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("bar_date")).agg(
        F.max(unit).alias("high"), F.min(unit).alias("low"), (money / pieces).alias("close"), pieces.alias("volume")
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: all brands of a day together."""
    items = table(spark, sf_dir, "lineitem")
    money, pieces = (F.sum(F.col(x).cast("decimal(18,2)")).cast("double") for x in ("l_extendedprice", "l_quantity"))
    return items.groupBy(F.col("l_shipdate").cast("date").alias("bar_date")).agg((money / pieces).alias("close"))


def raw_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals as text, some unknown, from part counts and sizes."""
    n, s = F.col("n"), F.col("s")
    text = lambda x: x.cast("string")
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("ticker"))
        .agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("s"))
        .select(
            "ticker",
            F.when(s % 5 == 0, F.lit("N/A")).otherwise(text(s % 60)).alias("trailing_pe"), text(s % 45).alias("forward_pe"),
            F.when(s % 3 == 0, F.lit("")).otherwise(text(n % 4)).alias("peg"), text(s % 12).alias("price_to_book"), text(s * 1000).alias("market_cap"),
            text((s % 40) / 100.0).alias("margin"), F.when(n % 4 == 0, F.lit("None")).otherwise(text((n % 30) / 100.0)).alias("return_on_equity"),
            text(s % 200).alias("debt"), text((s % 50 - 20) / 100.0).alias("revenue"), text((n % 7) * (s % 2) / 20.0).alias("earnings"), text((n % 9) / 25.0).alias("earnings_quarter"), text((s % 6) / 100.0).alias("dividend"),
        )
    )
