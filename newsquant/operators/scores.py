"""Scores and ratings of a ticker for four holding periods; ``when`` chains over metrics.

Thresholds, weights and labels are fixed values of the rating scheme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamped, steps, truthy

c = F.col
STYLES = ("day", "swing", "position", "longterm")


def _weighted(parts: dict[str, tuple[float, Column]]) -> tuple[Column, Column]:
    """The weighted sum and the struct of parts."""
    total = None
    for weight, part in parts.values():
        total = part * weight if total is None else total + part * weight
    return total, F.struct(*[part.alias(name) for name, (_, part) in parts.items()])


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _gain(*cases: tuple[Column, float]) -> Column:
    return steps(list(cases), 0.0)


def _with(df: DataFrame, style: str, parts: dict, labels: list[tuple[float, Column | None, str]], last: str) -> DataFrame:
    total, struct = _weighted(parts)
    out = df.withColumn(f"{style}_score", total).withColumn(f"{style}_components", struct)
    score = c(f"{style}_score")
    return out.withColumn(f"{style}_rating", steps([((score > low) if also is None else (score > low) & also, label) for low, also, label in labels], last))


def score_day(df: DataFrame) -> DataFrame:
    momentum = clamped(c("change_1d"), -3, 3) * 0.6 + clamped(c("change_1w"), -8, 8) * 0.4
    momentum = F.when(c("price_vs_ma10") > 0, F.least(F.lit(1.0), momentum * 1.15)).otherwise(momentum)
    swing = clamped(c("volatility_1w"), 0, 8) * F.when(c("volatility_1w") > 10, 0.5).otherwise(1.0)
    parts = {"momentum": (0.40, momentum), "volume": (0.35, clamped(c("volume_spike_ratio"), 0.8, 3.0)), "volatility": (0.25, swing)}
    labels = [(0.75, c("volume_spike_ratio") > 2.0, "🚀 HOT MOMENTUM"), (0.65, None, "📈 TRENDING"), (0.45, None, "⚡ VOLATILE"), (0.30, None, "📊 CHOPPY")]
    return _with(df, "day", parts, labels, "🛑 AVOID")


def score_swing(df: DataFrame) -> DataFrame:
    momentum = clamped(c("change_1w") * 0.3 + c("change_1m") * 0.4 + c("change_3m") * 0.3, -15, 15)
    trend = _gain((c("price_vs_ma20") > 0, 0.35)) + _gain((c("price_vs_ma50") > 0, 0.35)) + _gain((c("ma_20") > c("ma_50"), 0.30))
    rsi = steps([(c("rsi_14").between(40, 60), 1.0), (c("rsi_14").between(30, 70), 0.7)], 0.3)
    place = steps([(c("price_position_52w").between(30, 70), 1.0), (c("price_position_52w") < 30, 0.6)], 0.4)
    parts = {"momentum": (0.35, momentum), "trend_alignment": (0.30, trend), "volume": (0.20, clamped(c("volume_spike_ratio"), 0.7, 2.0)), "rsi_position": (0.15, (rsi + place) / 2)}
    labels = [(0.75, c("price_vs_ma50") > 0, "🎯 STRONG UPTREND"), (0.65, None, "📈 BULLISH SETUP"), (0.50, None, "👀 CONSOLIDATING"), (0.35, None, "⚠️ MIXED SIGNALS")]
    return _with(df, "swing", parts, labels, "🔻 DOWNTREND")


def _trend(far: float, values: tuple[float, float, float, float]) -> Column:
    above = c("price_vs_ma200")
    raw = steps([(above > far, values[0]), (above > 0, values[1]), (above > -far, values[2])], values[3])
    return F.when(c("ma_50") > c("ma_200"), F.least(F.lit(1.0), raw * 1.2)).otherwise(raw)


def score_position(df: DataFrame) -> DataFrame:
    value = F.lit(0.5) + F.when(c("pe_ratio") > 0, _gain((c("pe_ratio") < 20, 0.3), (c("pe_ratio") > 40, -0.2))).otherwise(0.0)
    value = value + F.when(c("peg_ratio") > 0, _gain((c("peg_ratio") < 1.5, 0.2), (c("peg_ratio") > 2.5, -0.2))).otherwise(0.0)
    parts = {
        "momentum": (0.30, clamped(c("change_3m") * 0.5 + c("change_1y") * 0.5, -20, 30)),
        "long_term_trend": (0.25, _trend(5, (1.0, 0.8, 0.5, 0.2))),
        "valuation": (0.25, _unit(value)),
        "stability": (0.20, clamped(c("volatility_3m"), 0, 8, invert=True)),
    }
    labels = [(0.75, None, "💎 STRONG BUY"), (0.65, None, "✅ BUY"), (0.50, None, "👍 HOLD"), (0.35, None, "⚠️ CAUTION")]
    return _with(df, "position", parts, labels, "❌ SELL/AVOID")


def _fundamental_parts() -> dict[str, tuple[float, Column]]:
    def plus(name: str, *cases: tuple[Column, float]) -> Column:
        return F.when(c(name) > 0, _gain(*cases)).otherwise(0.0)

    pe, peg, pb, debt, income = c("pe_ratio"), c("peg_ratio"), c("price_to_book"), c("debt_to_equity"), c("dividend_yield")
    value = F.lit(0.5) + plus("pe_ratio", (pe < 15, 0.25), (pe < 25, 0.10), (pe > 50, -0.25)) + plus("peg_ratio", (peg < 1.0, 0.25), (peg < 2.0, 0.10), (peg > 3.0, -0.20))
    value = value + plus("price_to_book", (pb < 3, 0.10), (pb > 10, -0.10))
    quality = F.lit(0.5) + plus("profit_margin", (c("profit_margin") > 0.20, 0.25), (c("profit_margin") > 0.10, 0.10)) + plus("roe", (c("roe") > 0.15, 0.25), (c("roe") > 0.10, 0.10))
    growth = F.lit(0.5)
    for name in ("revenue_growth", "earnings_growth"):
        growth = growth + plus(name, (c(name) > 0.15, 0.25), (c(name) > 0.05, 0.15))
    health = F.lit(0.5) + _gain((debt < 50, 0.25), (debt > 150, -0.25)) + plus("dividend_yield", (income > 3, 0.25), (income > 1.5, 0.15))
    return {"valuation": (0.30, _unit(value)), "quality": (0.25, _unit(quality)), "growth": (0.25, _unit(growth)), "health_income": (0.20, _unit(health))}


def has_fundamentals() -> Column:
    known = F.lit(False)
    for name in ("pe_ratio", "peg_ratio", "profit_margin", "roe", "revenue_growth", "earnings_growth"):
        known = known | truthy(c(name))
    return known


def score_longterm(df: DataFrame, fallback: bool = True) -> DataFrame:
    """By fundamentals; by price history where all of them are unknown and ``fallback`` is set."""
    labels = [(0.75, None, "⭐ EXCELLENT"), (0.65, None, "👍 GOOD"), (0.50, None, "✋ FAIR"), (0.35, None, "⚠️ BELOW AVERAGE")]
    main, main_parts = _weighted(_fundamental_parts())
    other, other_parts = _weighted(
        {
            "long_term_performance": (0.40, clamped(c("change_1y"), -20, 50) * 0.6 + clamped(c("change_5y"), -50, 200) * 0.4),
            "trend_strength": (0.30, _trend(10, (1.0, 0.7, 0.4, 0.2))),
            "stability": (0.20, clamped(c("volatility_1y"), 0, 10, invert=True)),
            "relative_position": (0.10, clamped(c("price_position_52w"), 20, 80)),
        }
    )
    known = has_fundamentals() | F.lit(not fallback)
    both = F.struct(F.when(known, main_parts).alias("fundamental"), F.when(~known, other_parts).alias("technical"))
    out = df.withColumn("longterm_score", F.when(known, main).otherwise(other)).withColumn("longterm_components", both)
    return out.withColumn("longterm_rating", steps([(c("longterm_score") > low, label) for low, _, label in labels], "🚫 POOR"))


def score_all(df: DataFrame) -> DataFrame:
    """All four scores, component structs and ratings."""
    return score_longterm(score_position(score_swing(score_day(df))))
