"""Queries over price bars: indicators, scores, rankings; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_integer
from ..operators import indicators, reporting, scores
from ..sources import files, fixtures, readers

Query = Callable[[SparkSession, str], DataFrame]

CHANGES = ["change_1d", "change_1w", "change_1m", "change_3m", "change_1y", "change_5y"]
VOLUMES = ["current_volume", "avg_volume_5d", "avg_volume_30d", "volume_spike_ratio"]
VOLATILITY = ["volatility_1w", "volatility_1m", "volatility_3m", "volatility_1y"]
AVERAGES = ["ma_10", "ma_20", "ma_50", "ma_200"]
DISTANCES = ["price_vs_ma10", "price_vs_ma20", "price_vs_ma50", "price_vs_ma200"]
RSI = ["rsi_7", "rsi_14"]
RANGE = ["high_52w", "low_52w", "price_position_52w"]
FUNDAMENTALS = ["pe_ratio", "forward_pe", "peg_ratio", "price_to_book", "profit_margin", "roe", "debt_to_equity", "revenue_growth", "earnings_growth", "market_cap", "dividend_yield"]
METRICS = ["current_price", *CHANGES, *VOLUMES, *VOLATILITY, *AVERAGES, *DISTANCES, *RSI, *RANGE, *FUNDAMENTALS]


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.stock_metrics(fixtures.bars(spark, sf_dir), readers.clean_fundamentals(fixtures.raw_fundamentals(spark, sf_dir)))


def _whole_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = files.saved(fixtures.bars(spark, sf_dir), "bars")
    own = indicators.stock_metrics(bars, readers.clean_fundamentals(fixtures.raw_fundamentals(spark, sf_dir)), None, fixtures.market(spark, sf_dir))
    return _rounded(own, [*METRICS, "beta"])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_all(_metrics(spark, sf_dir))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("ticker", *[F.round(n, 6).alias(n) for n in names])


def _part(names: list[str]) -> Query:
    return lambda spark, sf_dir: _rounded(indicators.technical_metrics(fixtures.bars(spark, sf_dir)), names)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.period_flags(fixtures.bars(spark, sf_dir))
    return out.groupBy("ticker").agg(*[F.count_if(f"in_{k}").alias(f"n_{k}") for k in indicators.SLICES])


def _score(style: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scored(spark, sf_dir).select("ticker", F.round(f"{style}_score", 6).alias("score"), F.col(f"{style}_rating").alias("rating"))

    return run


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = {n: F.lit(None).cast("double") for n in ("pe_ratio", "peg_ratio", "profit_margin", "roe", "revenue_growth", "earnings_growth")}
    out = scores.score_longterm(_metrics(spark, sf_dir).withColumns(unknown))
    return out.select("ticker", F.round("longterm_score", 6).alias("score"), F.col("longterm_rating").alias("rating"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("ticker", *[f"{s}_rating" for s in scores.STYLES])


def _clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import clamped

    rows = fixtures.table(spark, sf_dir, "part")
    x = F.col("p_retailprice")
    return rows.select("p_partkey", F.round(clamped(x, 950, 1500), 6).alias("up"), F.round(clamped(x, 950, 1500, invert=True), 6).alias("down"), clamped(x, 5, 5).alias("flat"))


def _format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import safe_number

    rows = fixtures.raw_fundamentals(spark, sf_dir)
    return rows.select("ticker", *[safe_number(F.col(n), d).alias(n) for n, d in (("trailing_pe", 2), ("peg", 2), ("margin", 4), ("return_on_equity", 4))])


def _beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(indicators.beta(fixtures.bars(spark, sf_dir), fixtures.market(spark, sf_dir)), ["beta"])


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.recent_bars(fixtures.bars(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("bars"), F.max("bar_date").alias("last_date"))


def _top_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_overall(_scored(spark, sf_dir).withColumn("swing_score", F.round("swing_score", 6)), "swing", 10).select("ticker", "swing_score", "swing_rating")


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship card of one symbol; the filter reaches the bars before any window."""
    all_bars = fixtures.bars(spark, sf_dir)
    day = indicators.as_of(all_bars)
    out = reporting.ticker_card(all_bars, readers.clean_fundamentals(fixtures.raw_fundamentals(spark, sf_dir)), "brand#23", day)
    return out.select("ticker", *[F.round(n, 6).alias(n) for n in ("current_price", "change_1d", "rsi_14", "day_score", "swing_score", "position_score", "longterm_score")], *[f"{s}_rating" for s in scores.STYLES])


def _long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rankings over topics (a brand's maker stands for its topic)."""
    own = _scored(spark, sf_dir).withColumn("topic_id", F.substring("ticker", 7, 1).cast("int")).withColumn("relevance_score", F.round(F.col("pe_ratio") / 60, 6))
    own = own.withColumns({f"{s}_score": F.round(f"{s}_score", 6) for s in scores.STYLES})
    return reporting.rank_by_style(own, 20)


def queries() -> dict[str, Query]:
    return {
        "S4_recent_bars": _recent,
        "S5_clean_fundamentals": lambda s, d: readers.clean_fundamentals(fixtures.raw_fundamentals(s, d)),
        "F1_period_slices": _flags,
        "F2_price_changes": _part(CHANGES),
        "F3_volume": _part(VOLUMES),
        "F4_volatility": _part(VOLATILITY),
        "F5_moving_averages": _part(AVERAGES),
        "F6_price_vs_ma": _part(DISTANCES),
        "F7_rsi": _part(RSI),
        "F8_range_52w": _part(RANGE),
        "F9_beta": _beta,
        "F10_stock_metrics": _whole_metrics,
        "C1_normalize": _clamp,
        "C2_day_score": _score("day"),
        "C3_swing_score": _score("swing"),
        "C4_position_score": _score("position"),
        "C5_longterm_score": _score("longterm"),
        "C6_longterm_fallback": _fallback,
        "C7_ratings": _ratings,
        "C8_safe_format": _format,
        "C8_safe_integers": lambda s, d: fixtures.table(s, d, "part").select("p_partkey", safe_integer(F.col("p_retailprice") * 1e12 - 2e15).alias("whole"), safe_integer(F.col("p_name")).alias("none")),
        "R1_rank_by_style": _long_scores,
        "R2_top_overall": _top_overall,
        "R7_ticker_card": _card,
    }


BARS = """bars as (
  select p_brand as ticker, cast(l_shipdate as date) as bar_date, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
day as (select max(bar_date) as as_of from bars)"""
RAW = """raw as (
  select ticker, case when s % 5 = 0 then 'N/A' else (s % 60)::varchar end as trailing_pe, (s % 45)::varchar as forward_pe, case when s % 3 = 0 then '' else (n % 4)::varchar end as peg,
    (s % 12)::varchar as price_to_book, (s * 1000)::varchar as market_cap, ((s % 40) / 100.0::double)::varchar as margin, case when n % 4 = 0 then 'None' else ((n % 30) / 100.0::double)::varchar end as return_on_equity,
    (s % 200)::varchar as debt, ((s % 50 - 20) / 100.0::double)::varchar as revenue, ((n % 7) * (s % 2) / 20.0::double)::varchar as earnings, ((n % 9) / 25.0::double)::varchar as earnings_quarter, ((s % 6) / 100.0::double)::varchar as dividend
  from (select p_brand as ticker, count(*) as n, sum(p_size)::bigint as s from part group by 1)),
fund as (
  select ticker, coalesce(nullif(try_cast(trailing_pe as double), 0), try_cast(forward_pe as double)) as pe_ratio, try_cast(forward_pe as double) as forward_pe, try_cast(peg as double) as peg_ratio,
    try_cast(price_to_book as double) as price_to_book, try_cast(margin as double) as profit_margin, try_cast(return_on_equity as double) as roe, try_cast(debt as double) as debt_to_equity,
    try_cast(revenue as double) as revenue_growth, coalesce(nullif(try_cast(earnings as double), 0), try_cast(earnings_quarter as double)) as earnings_growth, coalesce(try_cast(market_cap as double), 0) as market_cap,
    case when try_cast(dividend as double) > 0 then try_cast(dividend as double) * 100 else 0 end as dividend_yield
  from raw)"""


def _sql_metrics() -> str:
    flags = ", ".join(f"bar_date >= as_of - {n} as in_{k}" for k, n in indicators.SLICES.items())
    opens = ", ".join(f"in_{k} and not coalesce(lag(in_{k}) over w, false) as open_{k}" for k in indicators.SLICES)
    first = ", ".join(f"max(close) filter (open_{k}) as o_{k}" for k in indicators.SLICES)
    spread = ", ".join(f"stddev_samp(ret) filter (in_{k} and not open_{k}) * 100 as v_{k}" for k in ("m1", "m3", "y1"))
    means = ", ".join(f"case when count(*) filter (rn <= {n} and in_{k}) >= {n} then avg(close) filter (rn <= {n} and in_{k}) end as a{n}" for n, k in ((10, "m1"), (20, "m1"), (50, "m3"), (200, "y1")))
    moves = ", ".join(
        f"case when count(*) filter (rn <= {n} and in_m1) >= {n} then sum(case when open_m1 then 0 else greatest({sign}delta, 0) end) filter (rn <= {n} and in_m1) / {n} end as {name}{n}"
        for n in (7, 14)
        for sign, name in (("", "g"), ("-", "l"))
    )
    rsi = lambda n: f"case when l{n} > 0 then 100 - 100 / (1 + g{n} / l{n}) when g{n} > 0 then 100 end"
    return f"""{BARS}, {RAW},
sliced as (select bars.*, {flags} from bars, day where bar_date >= as_of - 1825),
steps as (select *, row_number() over (partition by ticker order by bar_date desc) as rn, close / lag(close) over w - 1 as ret0, (close - lag(close) over w) / lag(close) over w as ret, close - lag(close) over w as delta, {opens}
  from sliced window w as (partition by ticker order by bar_date)),
sums as (select ticker, count(*) filter (in_m1) as n1, max(close) filter (rn = 1 and in_m1) as current_price, max(close) filter (rn = 2 and in_m1) as p2, max(close) filter (rn = 5 and in_m1) as p5, {first},
    max(volume) filter (rn = 1 and in_m1) as current_volume, avg(volume) filter (rn <= 5 and in_m1) as avg_volume_5d, avg(volume) filter (in_m1) as avg_volume_30d,
    stddev_samp(ret) filter (rn <= 4 and in_m1) * 100 as v_w, {spread}, {means}, {moves}, max(high) filter (in_y1) as high_52w, min(low) filter (in_y1) as low_52w
  from steps group by ticker having count(*) filter (in_m1) > 0),
base as (select *, case when avg_volume_5d > 0 then current_volume / avg_volume_5d else 1 end as volume_spike_ratio,
    (current_price - coalesce(p2, current_price)) / coalesce(p2, current_price) * 100 as change_1d, (current_price - coalesce(p5, current_price)) / coalesce(p5, current_price) * 100 as change_1w,
    (current_price - o_m1) / o_m1 * 100 as change_1m, (current_price - o_m3) / o_m3 * 100 as change_3m, (current_price - o_y1) / o_y1 * 100 as change_1y, (current_price - o_y5) / o_y5 * 100 as change_5y,
    case when n1 >= 5 then v_w else 0 end as volatility_1w, v_m1 as volatility_1m, v_m3 as volatility_3m, v_y1 as volatility_1y,
    coalesce(a10, current_price) as ma_10, coalesce(a20, current_price) as ma_20, coalesce(a50, current_price) as ma_50, coalesce(a200, current_price) as ma_200,
    {rsi(14)} as rsi_14, case when n1 >= 7 then {rsi(7)} else {rsi(14)} end as rsi_7,
    case when high_52w <> low_52w then (current_price - low_52w) / (high_52w - low_52w) * 100 else 50 end as price_position_52w
  from sums),
metrics as (select *, (current_price - ma_10) / ma_10 * 100 as price_vs_ma10, (current_price - ma_20) / ma_20 * 100 as price_vs_ma20, (current_price - ma_50) / ma_50 * 100 as price_vs_ma50, (current_price - ma_200) / ma_200 * 100 as price_vs_ma200
  from base left join fund using (ticker))"""


def _sql_unit(x: str, low: float, high: float) -> str:
    return f"greatest(0, least(1, ({x} - ({low})) / ({high} - ({low}))))"


def _sql_scores(source: str = "metrics") -> str:
    trend = lambda far, v: f"(case when price_vs_ma200 > {far} then {v[0]} when price_vs_ma200 > 0 then {v[1]} when price_vs_ma200 > -{far} then {v[2]} else {v[3]} end)"
    up = lambda t: f"(case when ma_50 > ma_200 then least(1, {t} * 1.2) else {t} end)"
    raw = f"({_sql_unit('change_1d', -3, 3)} * 0.6 + {_sql_unit('change_1w', -8, 8)} * 0.4)"
    day = f"0.40 * (case when price_vs_ma10 > 0 then least(1, {raw} * 1.15) else {raw} end) + 0.35 * {_sql_unit('volume_spike_ratio', 0.8, 3.0)} + 0.25 * {_sql_unit('volatility_1w', 0, 8)} * (case when volatility_1w > 10 then 0.5 else 1 end)"
    swing = f"""0.35 * {_sql_unit('(change_1w * 0.3 + change_1m * 0.4 + change_3m * 0.3)', -15, 15)}
      + 0.30 * ((case when price_vs_ma20 > 0 then 0.35 else 0 end) + (case when price_vs_ma50 > 0 then 0.35 else 0 end) + (case when ma_20 > ma_50 then 0.30 else 0 end))
      + 0.20 * {_sql_unit('volume_spike_ratio', 0.7, 2.0)}
      + 0.15 * ((case when rsi_14 between 40 and 60 then 1.0 when rsi_14 between 30 and 70 then 0.7 else 0.3 end) + (case when price_position_52w between 30 and 70 then 1.0 when price_position_52w < 30 then 0.6 else 0.4 end)) / 2"""
    position = f"""0.30 * {_sql_unit('(change_3m * 0.5 + change_1y * 0.5)', -20, 30)} + 0.25 * {up(trend(5, (1.0, 0.8, 0.5, 0.2)))}
      + 0.25 * greatest(0, least(1, 0.5 + (case when pe_ratio > 0 and pe_ratio < 20 then 0.3 when pe_ratio > 40 then -0.2 else 0 end) + (case when peg_ratio > 0 and peg_ratio < 1.5 then 0.2 when peg_ratio > 2.5 then -0.2 else 0 end)))
      + 0.20 * (1 - {_sql_unit('volatility_3m', 0, 8)})"""
    main = """0.30 * greatest(0, least(1, 0.5 + (case when pe_ratio > 0 and pe_ratio < 15 then 0.25 when pe_ratio > 0 and pe_ratio < 25 then 0.1 when pe_ratio > 50 then -0.25 else 0 end)
        + (case when peg_ratio > 0 and peg_ratio < 1 then 0.25 when peg_ratio > 0 and peg_ratio < 2 then 0.1 when peg_ratio > 3 then -0.2 else 0 end) + (case when price_to_book > 0 and price_to_book < 3 then 0.1 when price_to_book > 10 then -0.1 else 0 end)))
      + 0.25 * greatest(0, least(1, 0.5 + (case when profit_margin > 0.2 then 0.25 when profit_margin > 0.1 then 0.1 else 0 end) + (case when roe > 0.15 then 0.25 when roe > 0.1 then 0.1 else 0 end)))
      + 0.25 * greatest(0, least(1, 0.5 + (case when revenue_growth > 0.15 then 0.25 when revenue_growth > 0.05 then 0.15 else 0 end) + (case when earnings_growth > 0.15 then 0.25 when earnings_growth > 0.05 then 0.15 else 0 end)))
      + 0.20 * greatest(0, least(1, 0.5 + (case when debt_to_equity < 50 then 0.25 when debt_to_equity > 150 then -0.25 else 0 end) + (case when dividend_yield > 3 then 0.25 when dividend_yield > 1.5 then 0.15 else 0 end)))"""
    other = f"0.40 * ({_sql_unit('change_1y', -20, 50)} * 0.6 + {_sql_unit('change_5y', -50, 200)} * 0.4) + 0.30 * {up(trend(10, (1.0, 0.7, 0.4, 0.2)))} + 0.20 * (1 - {_sql_unit('volatility_1y', 0, 10)}) + 0.10 * {_sql_unit('price_position_52w', 20, 80)}"
    known = " or ".join(f"coalesce({n}, 0) <> 0" for n in ("pe_ratio", "peg_ratio", "profit_margin", "roe", "revenue_growth", "earnings_growth"))
    return f"""scored as (select *, ({day})::double as day_score, ({swing})::double as swing_score, ({position})::double as position_score, (case when {known} then {main} else {other} end)::double as longterm_score from {source}),
rated as (select *,
    case when day_score > 0.75 and volume_spike_ratio > 2 then '🚀 HOT MOMENTUM' when day_score > 0.65 then '📈 TRENDING' when day_score > 0.45 then '⚡ VOLATILE' when day_score > 0.30 then '📊 CHOPPY' else '🛑 AVOID' end as day_rating,
    case when swing_score > 0.75 and price_vs_ma50 > 0 then '🎯 STRONG UPTREND' when swing_score > 0.65 then '📈 BULLISH SETUP' when swing_score > 0.50 then '👀 CONSOLIDATING' when swing_score > 0.35 then '⚠️ MIXED SIGNALS' else '🔻 DOWNTREND' end as swing_rating,
    case when position_score > 0.75 then '💎 STRONG BUY' when position_score > 0.65 then '✅ BUY' when position_score > 0.50 then '👍 HOLD' when position_score > 0.35 then '⚠️ CAUTION' else '❌ SELL/AVOID' end as position_rating,
    case when longterm_score > 0.75 then '⭐ EXCELLENT' when longterm_score > 0.65 then '👍 GOOD' when longterm_score > 0.50 then '✋ FAIR' when longterm_score > 0.35 then '⚠️ BELOW AVERAGE' else '🚫 POOR' end as longterm_rating
  from scored)"""


def oracle_sql() -> dict[str, str]:
    metrics, scored = _sql_metrics(), _sql_scores()
    rounds = lambda names: ", ".join(f"round({n}, 6) as {n}" for n in names)
    part = lambda names: f"with {metrics} select ticker, {rounds(names)} from metrics"
    out = {f"F{n}_{name}": part(names) for n, name, names in ((2, "price_changes", CHANGES), (3, "volume", VOLUMES), (4, "volatility", VOLATILITY), (5, "moving_averages", AVERAGES), (6, "price_vs_ma", DISTANCES), (7, "rsi", RSI), (8, "range_52w", RANGE), (10, "stock_metrics", METRICS))}
    for n, style, name in ((2, "day", "day"), (3, "swing", "swing"), (4, "position", "position"), (5, "longterm", "longterm")):
        out[f"C{n}_{name}_score"] = f"with {metrics}, {scored} select ticker, round({style}_score, 6) as score, {style}_rating as rating from rated"
    unknown = ", ".join(f"null::double as {n}" for n in ("pe_ratio", "peg_ratio", "profit_margin", "roe", "revenue_growth", "earnings_growth"))
    blank = f"blank as (select * replace ({unknown}) from metrics)"
    styles = ", ".join(f"{s}_rating" for s in scores.STYLES)
    longs = " union all ".join(f"select topic_id, '{s}' as style, ticker, relevance_score, round({s}_score, 6) as score, {s}_rating as rating from t" for s in scores.STYLES)
    out |= {
        "S4_recent_bars": f"with {BARS} select ticker, count(*) as bars, max(bar_date) as last_date from bars where ticker in (select ticker from bars, day where bar_date >= as_of - 30) group by 1",
        "S5_clean_fundamentals": f"with {RAW} select * from fund",
        "F1_period_slices": f"with {BARS} select ticker, " + ", ".join(f"count(*) filter (bar_date >= as_of - {n}) as n_{k}" for k, n in indicators.SLICES.items()) + " from bars, day where bar_date >= as_of - 1825 group by 1",
        "F9_beta": f"""with {BARS}, own as (select ticker, bar_date, close / lag(close) over (partition by ticker order by bar_date) - 1 as ret, count(*) over (partition by ticker) as n_bars from bars, day where bar_date >= as_of - 365),
market as (select bar_date, close / lag(close) over (order by bar_date) - 1 as market_ret from (select cast(l_shipdate as date) as bar_date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close from lineitem group by 1), day where bar_date >= as_of - 365)
select ticker, round(covar_samp(ret, market_ret) / var_pop(market_ret), 6) as beta from own join market using (bar_date) where ret is not null and market_ret is not null group by 1 having count(*) >= 30 and max(n_bars) >= 30 and var_pop(market_ret) > 0""",
        "C1_normalize": "select p_partkey, round(greatest(0, least(1, (p_retailprice - 950) / 550)), 6) as up, round(1 - greatest(0, least(1, (p_retailprice - 950) / 550)), 6) as down, 0.5::double as flat from part",
        "C6_longterm_fallback": f"with {metrics}, {blank}, {_sql_scores('blank')} select ticker, round(longterm_score, 6) as score, longterm_rating as rating from rated",
        "C7_ratings": f"with {metrics}, {scored} select ticker, {styles} from rated",
        "C8_safe_integers": "select p_partkey, case when abs(trunc(p_retailprice * 1e12::double - 2e15::double)) <= 1e15::double then trunc(p_retailprice * 1e12::double - 2e15::double)::bigint end as whole, null::bigint as none from part",
        "C8_safe_format": f"with {RAW} select ticker, round(try_cast(trailing_pe as double), 2) as trailing_pe, round(try_cast(peg as double), 2) as peg, round(try_cast(margin as double), 4) as margin, round(try_cast(return_on_equity as double), 4) as return_on_equity from raw",
        "R1_rank_by_style": f"""with {metrics}, {scored}, t as (select *, substr(ticker, 7, 1)::int as topic_id, round(pe_ratio / 60, 6) as relevance_score from rated), longs as ({longs})
select topic_id, style, ticker, relevance_score, score, rating, rank, missing from (select *, row_number() over (partition by topic_id, style order by relevance_score desc nulls last, score desc, ticker)::int as rank from (select *, count(*) filter (score is null) over (partition by topic_id, style) as missing from longs) where score is not null) where rank <= 20""",
        "R2_top_overall": f"with {metrics}, {scored} select ticker, round(swing_score, 6) as swing_score, swing_rating from rated where swing_score is not null order by round(swing_score, 6) desc, ticker limit 10",
        "R7_ticker_card": f"with {metrics}, {scored} select ticker, {rounds(['current_price', 'change_1d', 'rsi_14', 'day_score', 'swing_score', 'position_score', 'longterm_score'])}, {styles} from rated where ticker = 'Brand#23'",
    }
    out["F10_stock_metrics"] = f"with {metrics} select ticker, {rounds(METRICS)}, beta from metrics left join ({out['F9_beta']}) b using (ticker)"
    return out
