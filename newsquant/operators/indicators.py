"""Price indicators per ticker: one window pass over the bars, one aggregation.

Bars are ``(ticker, bar_date, high, low, close, volume)``. The as-of date is the last date of
the table or a parameter, never the clock. Only the last five years are read, so a ticker's
window is bounded by its bars of five years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent

SLICES = {"m1": 30, "m3": 90, "y1": 365, "y5": 1825}


def as_of(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("bar_date").alias("as_of"))


def period_flags(bars: DataFrame, day: DataFrame | None = None) -> DataFrame:
    """Bars of the last five years with a flag per period slice."""
    day = as_of(bars) if day is None else day
    out = bars.join(F.broadcast(day), F.col("bar_date") <= F.col("as_of"))
    out = out.withColumns({f"in_{k}": F.col("bar_date") >= F.date_sub("as_of", n) for k, n in SLICES.items()})
    return out.where("in_y5")


def with_returns(bars: DataFrame) -> DataFrame:
    """Add the bar's rank from the last, its return, its change and whether it opens a slice."""
    ordered = Window.partitionBy("ticker").orderBy("bar_date")
    before = F.lag("close").over(ordered)
    out = bars.withColumns({"rn": F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("bar_date").desc())), "_before": before})
    out = out.withColumns({"ret": F.try_divide(F.col("close") - F.col("_before"), F.col("_before")), "delta": F.col("close") - F.col("_before")})
    opens = {f"open_{k}": F.col(f"in_{k}") & ~F.coalesce(F.lag(f"in_{k}").over(ordered), F.lit(False)) for k in SLICES}
    return out.withColumns(opens).drop("_before")


def _last(k: int, value: str = "close") -> Column:
    return F.max(F.when((F.col("rn") == k) & F.col("in_m1"), F.col(value)))


def _opening(k: str) -> Column:
    return F.max(F.when(F.col(f"open_{k}"), F.col("close")))


def _mean(k: int, part: str) -> Column:
    inside = (F.col("rn") <= k) & F.col(f"in_{part}")
    return F.when(F.count_if(inside) >= k, F.avg(F.when(inside, F.col("close"))))


def _spread(part: str) -> Column:
    return F.stddev_samp(F.when(F.col(f"in_{part}") & ~F.col(f"open_{part}"), F.col("ret"))) * 100


def _moves(n: int, up: bool) -> Column:
    """Mean gain or loss over the last ``n`` bars of a month; its first bar counts as no move."""
    move = F.greatest(F.col("delta"), F.lit(0.0)) if up else F.greatest(-F.col("delta"), F.lit(0.0))
    inside = (F.col("rn") <= n) & F.col("in_m1")
    return F.when(F.count_if(inside) >= n, F.sum(F.when(inside, F.when(F.col("open_m1"), 0.0).otherwise(move))) / n)


def _rsi(gain: Column, loss: Column) -> Column:
    return F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, F.lit(100.0))


def technical_metrics(bars: DataFrame, day: DataFrame | None = None) -> DataFrame:
    """One row per ticker that has a bar in the last month."""
    rows = with_returns(period_flags(bars, day))
    spike5 = F.avg(F.when((F.col("rn") <= 5) & F.col("in_m1"), F.col("volume")))
    out = rows.groupBy("ticker").agg(
        F.count_if("in_m1").alias("bars_m1"),
        _last(1).alias("current_price"), _last(2).alias("_p2"), _last(5).alias("_p5"),
        *[_opening(k).alias(f"_{k}") for k in SLICES],
        _last(1, "volume").alias("current_volume"), spike5.alias("avg_volume_5d"), F.avg(F.when(F.col("in_m1"), F.col("volume"))).alias("avg_volume_30d"),
        F.stddev_samp(F.when((F.col("rn") <= 4) & F.col("in_m1"), F.col("ret"))).alias("_v1w"),
        *[_spread(k).alias(f"_v{k}") for k in ("m1", "m3", "y1")],
        _mean(10, "m1").alias("_ma10"), _mean(20, "m1").alias("_ma20"), _mean(50, "m3").alias("_ma50"), _mean(200, "y1").alias("_ma200"),
        *[_moves(n, up).alias(f"_{'gain' if up else 'loss'}{n}") for n in (7, 14) for up in (True, False)],
        F.max(F.when(F.col("in_y1"), F.col("high"))).alias("high_52w"), F.min(F.when(F.col("in_y1"), F.col("low"))).alias("low_52w"),
    ).where("bars_m1 > 0")
    now = F.col("current_price")
    out = out.withColumns(
        {
            "change_1d": percent(now, F.coalesce("_p2", now)), "change_1w": percent(now, F.coalesce("_p5", now)),
            "change_1m": percent(now, F.col("_m1")), "change_3m": percent(now, F.col("_m3")), "change_1y": percent(now, F.col("_y1")), "change_5y": percent(now, F.col("_y5")),
            "volume_spike_ratio": F.when(F.col("avg_volume_5d") > 0, F.try_divide("current_volume", "avg_volume_5d")).otherwise(1.0),
            "volatility_1w": F.when(F.col("bars_m1") >= 5, F.col("_v1w") * 100).otherwise(0.0),
            "volatility_1m": F.col("_vm1"), "volatility_3m": F.col("_vm3"), "volatility_1y": F.col("_vy1"),
            **{f"ma_{k}": F.coalesce(F.col(f"_ma{k}"), now) for k in (10, 20, 50, 200)},
            "rsi_14": _rsi(F.col("_gain14"), F.col("_loss14")),
            "price_position_52w": F.when(F.col("high_52w") != F.col("low_52w"), F.try_divide(now - F.col("low_52w"), F.col("high_52w") - F.col("low_52w")) * 100).otherwise(50.0),
        }
    )
    out = out.withColumns({f"price_vs_ma{k}": percent(now, F.col(f"ma_{k}")) for k in (10, 20, 50, 200)})
    out = out.withColumn("rsi_7", F.when(F.col("bars_m1") >= 7, _rsi(F.col("_gain7"), F.col("_loss7"))).otherwise(F.col("rsi_14")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def beta(bars: DataFrame, market: DataFrame) -> DataFrame:
    """``(ticker, beta)``: sample covariance over population variance of the last year's returns."""
    day = as_of(bars)
    own = period_flags(bars, day).where("in_y1")
    step = Window.partitionBy("ticker").orderBy("bar_date")
    own = own.withColumns({"ret": F.try_divide("close", F.lag("close").over(step)) - 1, "n_bars": F.count("*").over(Window.partitionBy("ticker"))})
    all_days = market.join(F.broadcast(day), F.col("bar_date") >= F.date_sub("as_of", SLICES["y1"]))
    # one row per day of a year: the market's window is small whatever the number of tickers
    index = all_days.withColumn("market_ret", F.try_divide("close", F.lag("close").over(Window.partitionBy(F.lit(1)).orderBy("bar_date"))) - 1)
    both = own.join(index.select("bar_date", "market_ret"), "bar_date").where("ret is not null and market_ret is not null")
    out = both.groupBy("ticker").agg(F.count("*").alias("n"), F.max("n_bars").alias("n_bars"), F.covar_samp("ret", "market_ret").alias("cov"), F.var_pop("market_ret").alias("var"))
    return out.where("n >= 30 and n_bars >= 30 and var > 0").select("ticker", (F.col("cov") / F.col("var")).alias("beta"))


def stock_metrics(bars: DataFrame, fundamentals: DataFrame, day: DataFrame | None = None, market: DataFrame | None = None) -> DataFrame:
    """Technical metrics with fundamentals, and with the beta to ``market`` if given, one row per ticker."""
    out = technical_metrics(bars, day).join(fundamentals, "ticker", "left")
    return out if market is None else out.join(beta(bars, market), "ticker", "left")
