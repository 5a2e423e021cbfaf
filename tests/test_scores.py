import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsquant.functions.columns import clamped, safe_number
from newsquant.operators import indicators, matching, reporting, scores, topics


def bars(spark, closes, ticker="X"):
    day = dt.date(2024, 3, 1)
    rows = [(ticker, day - dt.timedelta(days=len(closes) - 1 - i), c + 1.0, c - 1.0, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, bar_date date, high double, low double, close double, volume double")


def test_one_bar_falls_back_to_the_price(spark):
    row = indicators.technical_metrics(bars(spark, [50])).collect()[0]
    assert (row.change_1d, row.change_1w, row.volatility_1w, row.ma_200) == (0.0, 0.0, 0.0, 50.0)
    assert row.rsi_14 is None and row.volume_spike_ratio == 1.0


def test_only_gains_have_rsi_100_and_flat_prices_none(spark):
    assert indicators.technical_metrics(bars(spark, range(10, 30))).collect()[0].rsi_14 == 100.0
    assert indicators.technical_metrics(bars(spark, [10] * 20)).collect()[0].rsi_14 is None


def test_clamp_of_unknown_is_one(spark):
    row = spark.sql("select cast(null as double) x, 5.0D y").select(clamped(F.col("x"), 0, 1).alias("a"), clamped(F.col("x"), 0, 1, True).alias("b"), clamped(F.col("y"), 0, 10).alias("c")).collect()[0]
    assert tuple(row) == (1.0, 0.0, 0.5)


def test_safe_number(spark):
    rows = spark.createDataFrame([("NaN",), ("x",), ("inf",), ("1.256",)], "s string").select(safe_number(F.col("s"), 2).alias("v")).collect()
    assert [r.v for r in rows] == [None, None, None, 1.26]


def metrics(spark, n=40):
    rng = random.Random(3)
    names = "change_1d change_1w change_1m change_3m change_1y change_5y volume_spike_ratio volatility_1w volatility_3m volatility_1y ma_20 ma_50 ma_200 price_vs_ma10 price_vs_ma20 price_vs_ma50 price_vs_ma200 rsi_14 price_position_52w pe_ratio peg_ratio price_to_book profit_margin roe debt_to_equity revenue_growth earnings_growth dividend_yield".split()
    rows = [tuple([f"T{i}"] + [None if rng.random() < 0.1 and k > 18 else rng.uniform(-20, 80) for k, _ in enumerate(names)]) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, " + ", ".join(f"{x} double" for x in names))


def test_scores_stay_in_unit_range(spark):
    for row in scores.score_all(metrics(spark)).collect():
        for style in scores.STYLES:
            assert 0 <= row[f"{style}_score"] <= 1 + 1e-9 and row[f"{style}_rating"]


@pytest.mark.parametrize("n, drop_at, kept", [(10, None, 10), (11, 11, 10), (60, None, 50)])
def test_adaptive_cut(spark, n, drop_at, kept):
    rows = [(1, f"T{i:03d}", 1.0 - i * 1e-4 - (0.2 if drop_at and i + 1 >= drop_at else 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "topic_id int, ticker string, relevance_score double")
    assert matching.adaptive_top_n(df).count() == kept


def test_small_topics_become_noise(spark):
    df = spark.createDataFrame([(i, 0) for i in range(8)] + [(9, 1)], "article_id long, topic_id int")
    assert {(r.article_id, r.topic_id) for r in topics.assign_topics(df).collect()} == {(i, 0) for i in range(8)} | {(9, -1)}


def test_terms_are_cut_at_the_widest_gap(spark):
    rows = [(1, t, s) for t, s in zip("abcdef", (0.9, 0.8, 0.7, 0.3, 0.2, 0.1))]
    out = topics.cut_terms(spark.createDataFrame(rows, "topic_id int, term string, score double"))
    assert sorted(r.term for r in out.collect()) == ["a", "b", "c"]


def test_report_names(spark):
    files = spark.createDataFrame([("/x/topic_a_depth-2_01-31-2024_09.csv", 5), ("/x/u1_topic_depth-2_01-31-2024_09.csv", 5), ("/x/topic.csv", 1)], "path string, length long")
    assert [(r.base, r.depth) for r in reporting.report_catalog(files).collect()] == [("topic_a", 2)]
