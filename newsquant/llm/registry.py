"""Queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .classifier import op9_quality_classifier
from .decontaminate import op12_decontamination
from .extraction import op8_extraction
from .lattice import op2_lattice
from .lines import op6_lines
from .packing import op7_packing
from .quality import RULES, STOP_WORDS, op1_quality
from .resampling import op11_importance_resampling
from .sharding import op3_sharding
from .simhash import op10_simhash
from .substrings import op5_substrings
from .whitening import op13_whitening

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_CLAUSES = " and ".join(
    f"{name} {sign} {bound}"
    for rule in RULES
    for name, sign, bound in ((rule.measure, ">=", rule.low), (rule.measure, "<=", rule.high))
    if bound is not None
)
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL_QUALITY = f"""
with t as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
grams as (
  select doc_id, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] as g
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from t where len(words) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from t),
m as (
  select t.doc_id, len(words)::bigint as n_words, list_sum([0::bigint] || list_transform(words, lambda w: length(w)::bigint))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^|]+', '', 'g')) as pipes, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) as letters,
    length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as upper, len(lines) as n_lines,
    len(list_filter(words, lambda w: list_contains([{_STOPS}], w))) as stops
  from t join lines using (doc_id) left join covered using (doc_id)),
r as (
  select *, coalesce(n_repeat_words / nullif(n_words, 0)::double, 0) as repeat_ratio, coalesce(word_chars / nullif(n_words, 0)::double, 0) as mean_word_chars,
    coalesce(n_symbols / nullif(n_words, 0)::double, 0) as symbol_ratio, coalesce(pipes / nullif(n_words, 0)::double, 0) as pipe_ratio,
    coalesce(upper / nullif(letters, 0)::double, 0) as upper_ratio, coalesce(stops / nullif(n_words, 0)::double, 0) as stop_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) as dup_line_ratio
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, ({_CLAUSES}) as kept
from r
"""

SQL_SUBSTRINGS = f"""
with t as (select doc_id, {_WORDS} as words from documents),
w as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from t where len(words) >= 13)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as low from w) where low < doc_id),
covered as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 13)) as p from gone) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when gone is null then array_to_string(words, ' ') else coalesce(kept, '') end) as kept_sha256
from t left join covered using (doc_id)
left join (select doc_id, string_agg(words[i], ' ' order by i) as kept from (select doc_id, words, gone, unnest(range(1, len(words) + 1)) as i from t join covered using (doc_id))
  where not list_contains(gone, i) group by doc_id) using (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_lattice": op2_lattice,
        "op3_sharding": op3_sharding,
        "op4_bpe": op4_bpe,
        "op5_substrings": op5_substrings,
        "op6_lines": op6_lines,
        "op7_packing": op7_packing,
        "op8_extraction": op8_extraction,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_simhash": op10_simhash,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_decontamination": op12_decontamination,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": SQL_QUALITY, "op5_substrings": SQL_SUBSTRINGS}
