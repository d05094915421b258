"""Queries of this package's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import langid, leakage, mixing, personal, records, residue, tokens
from veilspark.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = residue.residue(table(spark, folder, "synthetic_records"), "document_id", "full_text")
    return found.where("kind is not null").select(F.col("id").alias("document_id")).distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records with left-over text per synthetic_generator."""
    return residue.residue_report(table(spark, folder, "synthetic_records"), "document_id", "full_text", "synthetic_generator")


def p3_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals by source_system, language and document_type, with all subtotals; ``grouping`` tells which."""
    return tokens.token_budget(table(spark, folder, "synthetic_records"), "document_id", "full_text", ["source_system", "language", "document_type"], every=True)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "synthetic_records"), "full_text", ["document_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "false_negatives")
    found = personal.distinct_items(personal.items(df, "document_id", "full_text", learned=personal.learn(df, "full_text")))
    return found.select(F.col("id").alias("document_id"), F.col("type").alias("entity_type"), F.col("text").alias("entity_text"))


def p4_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "false_negatives")
    return personal.placeholders(df, "document_id", "full_text", personal.learn(df, "full_text")).withColumnRenamed("id", "document_id")


def p4_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with keyed surrogates; the key is a parameter and stands here for one kept elsewhere."""
    df = table(spark, folder, "false_negatives")
    return personal.surrogates(df, "document_id", "full_text", "example key", personal.learn(df, "full_text")).withColumnRenamed("id", "document_id")


def p4_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per type: distinct items, and surrogates that are shared, are real items, or are equal to their item."""
    df = table(spark, folder, "false_negatives")
    return personal.invariants(df, "document_id", "full_text", "example key", personal.learn(df, "full_text"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("longest_run") >= 24).select(F.col("id").alias("doc_id"), "item_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: documents that hold a run of it, and those that hold it reworded."""
    return leakage.item_report(_leaks(spark, folder), table(spark, folder, "eval_items"), "item_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].where("short").select("source")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def _languages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    return docs, langid.segments(docs, "doc_id", "text", langid.train(docs, "doc_id", "text", "lang"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, found = _languages(spark, folder)
    return langid.wrong_or_mixed(docs, found, "doc_id", "lang").withColumnRenamed("id", "doc_id")


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment with its place, language and confidence."""
    return _languages(spark, folder)[1].select(F.col("id").alias("doc_id"), F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.start", "s.lang", "s.confidence", "s.words")


def queries() -> dict:
    return records.queries() | {f.__name__: f for f in (p2_found, p2_report, p3_budget, p3_counts, p4_found, p4_placeholders, p4_surrogates, p4_invariants, p7_found, p7_report, p8_found, p8_report, p8_mix, p9_found, p9_segments)}


def oracle_sql() -> dict[str, str]:
    return records.oracle_sql()
