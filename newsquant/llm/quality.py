"""Operator 1: quality rules compiled into one projection, without user functions.

A table of thresholds over length, symbol, stop-word and line ratios becomes one Spark
projection; every measure is a built-in expression over the whole text.

A null or wordless text has zero words: all counts are 0 and the base fails. Very long texts
cost ``n log n``. Repeated rows get equal results. Extra columns pass through untouched unless
they bear a result's name, which is then replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the of and to in is it that for was on are with by be at this a der die das und in den von zu mit auf ist im nicht ein eine sich des für auch an als le la les de des et un une en du que est pour qui dans par sur pas au avec el los las del y que en una por con para no se su es lo".split()


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure`` is outside [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are those of :func:`measures`.
RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeats_itself", "repeat_ratio", high=0.5),
    Rule("short_or_long_words", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("cell_marks", "pipe_ratio", high=0.2),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("few_stop_words", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)
#: The two rules that every verdict includes.
BASE = ("too_few_words", "repeats_itself")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice, the first one included."""
    size = F.size(words)
    window = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twice = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, F.least(i + 1, last + 1))["h"]))
        starts = F.transform(twice, lambda x: x["i"])
        return F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))))

    return F.when(size < 3, F.lit(0)).otherwise(_let(F.sort_array(window), covered))


def measures(text: str, inner: str) -> dict[str, Column]:
    """Column expressions of the counts of one text column, by name; ``inner`` precedes names that are not results.

    Of them ``flat`` comes first, the others may use it.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flat, flat_name = F.trim(F.regexp_replace(own, SPACE, " ")), f"{inner}flat"
    words = F.when(F.col(flat_name) == "", F.array().cast("array<string>")).otherwise(F.split(flat_name, " "))
    lines = F.filter(F.split(own, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")) != "")
    return {
        flat_name: flat,
        f"{inner}words": words,
        "n_symbols": F.length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")).cast("long"),
        f"{inner}pipes": F.length(F.regexp_replace(own, r"[^|]+", "")),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        f"{inner}lines": F.size(lines),
        f"{inner}letters": F.length(F.regexp_replace(own, r"[^\p{L}]+", "")),
        f"{inner}upper": F.length(F.regexp_replace(own, r"[^\p{Lu}]+", "")),
    }


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` by a generator of one row, which the optimizer neither merges nor repeats."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that rules name."""
    inner = "_"
    while any(c.lower().startswith(inner) for c in df.columns):
        inner += "_"
    flat, words = f"{inner}flat", f"{inner}words"
    first = measures(text, inner)
    # each step stands apart, so that texts are cut once, whatever filters come later
    cut = _settled(_settled(df, {flat: first.pop(flat)}), first)
    stop = sorted(set(STOP_WORDS))
    n = F.size(words)
    cut = _settled(
        cut,
        {
            "n_words": n.cast("long"),
            "word_chars": (F.length(flat) - F.greatest(n - 1, F.lit(0))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(words)).cast("long"),
            f"{inner}stops": F.size(F.filter(words, lambda w: w.isin(*stop))),
        },
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    cut = cut.withColumns(
        {
            "repeat_ratio": share("n_repeat_words", "n_words"),
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "pipe_ratio": share(f"{inner}pipes", "n_words"),
            "upper_ratio": share(f"{inner}upper", f"{inner}letters"),
            "stop_ratio": share(f"{inner}stops", "n_words"),
            "dup_line_ratio": share("n_dup_lines", f"{inner}lines"),
        }
    )
    return cut.drop(*[c for c in cut.columns if c.startswith(inner)])


def _fails(rule: Rule) -> Column:
    value = F.col(rule.measure)
    low = F.lit(False) if rule.low is None else value < rule.low
    high = F.lit(False) if rule.high is None else value > rule.high
    return low | high


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add measures, ``base_failed``, ``failed`` (names of failed rules) and ``kept``."""
    out = with_measures(df, text)
    base = [r for r in rules if r.name in BASE]
    fails = [F.when(_fails(r), F.lit(r.name)) for r in rules]
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | _fails(rule)
    return out.withColumn("base_failed", base_failed).withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
