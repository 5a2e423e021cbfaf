"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, substring dedup, packing.

Every stage works on all that the one before kept, written as Parquet and read again. Each row
is a document of its own: rows that repeat an id are deduped against each other like others, and
rows with a null id are kept and cut like others, as documents that come after all with an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import Scratch
from newsquant.llm.lines import dedup_lines
from newsquant.llm.packing import pack_documents
from newsquant.llm.quality import apply_rules
from newsquant.llm.simhash import simhash_components
from newsquant.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, unique and rising with the id (nulls last), then the text.

    Where ids are unique and none is null, ``row`` is the id. Otherwise the rows are sorted, numbered
    and written, so that the numbers stay.
    """
    docs = docs.select(*COLUMNS)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").limit(1).count():
        return docs.withColumn("row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return Scratch(spark, "rows").save(docs.withColumn("row", F.monotonically_increasing_id()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return apply_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an alike, earlier line stands for; rows without a text stay."""
    return _counted(dedup_lines(_keyed(spark, docs), "row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id and text, of each SimHash component; texts without words are one component."""
    rows = _keyed(spark, docs)
    heads = simhash_components(rows, "row").where("row = component_id").select("row")
    return rows.join(heads, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that an earlier row holds; untouched texts stay as they are.

    Rows of which nothing is left go, those without a text too.
    """
    out = dedup_substrings(_keyed(spark, docs), "row", whole=True, carry=("doc_id", "lang", "source"))
    return _counted(out.withColumnRenamed("kept", "text")).where("n_chars > 0")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Components and best-fit order cannot be said in one SQL text; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
