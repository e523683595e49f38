"""A corpus pipeline: language ID, near-duplicates, repeated substrings, benchmark passages, and a mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.llm import decontaminate, language, mixing, simhash, suffix_dedup
from sparkscribe.llm.common import bound_batches, drop_tables, stage_table, table


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no learned language go.

    Null and empty texts go (they have no letter); texts of under 50 characters with a letter stay; repeated rows fare alike; null ids
    and other columns pass through; an empty table stays empty."""
    bound_batches(spark)
    model = language.fit_filters(language.training_rows(docs, F.lit(True)))
    return language.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id, a null one last.

    Empty texts are near-duplicates of each other; of rows that repeat id and text one stays; of rows of one id with different texts the one
    of the smaller hash; an empty table stays empty."""
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 that occurred earlier go; all documents stay, null texts as null, emptied ones as empty.

    Rows that repeat id and text are one document and keep the same text; null ids come last; an empty table stays empty. n_chars follows."""
    return _recount(suffix_dedup.without_repeats(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark windows go; all documents stay, null texts as null.

    An empty benchmark, or items without words, remove nothing; repeated rows fare alike; an empty table stays empty. n_chars follows."""
    return _recount(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: a row for each document, 0 for null and empty texts.

    A null source is a source of its own; repeated rows are separate documents; an empty table gives no rows."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", mix),
]

#: Fingerprints and language filters have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stage_table(stage(spark, docs, sf_dir))
        drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
