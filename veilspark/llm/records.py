"""Queries of the operators on whole records: near-duplicates, quota samples and overlaps between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.columns import normal
from veilspark.llm import neardup, quotasample, splitoverlap
from veilspark.sources.tables import table

FIELDS = ["scenario", "language", "contains_personal_data", "recommended_split"]


def _near(spark: SparkSession, folder: str, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, folder, "synthetic_records"), "document_id", "full_text", "scenario_type", threshold, k)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.member_pairs(*_near(spark, folder, 0.7, 3))
    return pairs.select(F.col("a").alias("document_id_a"), F.col("b").alias("document_id_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's class of equal texts with its number of near-duplicate texts (five words, 0.8)."""
    return neardup.duplicate_classes(*_near(spark, folder, 0.8, 5))


def _sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return quotasample.quota_sample(table(spark, folder, "generation_requests"), table(spark, folder, "sample_targets"), "request_id", FIELDS, order_col="received_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1].where("short").select("field", "category")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[1]


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sample(spark, folder)[0].withColumnRenamed("id", "request_id")


def _overlaps(spark: SparkSession, folder: str, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    return splitoverlap.split_overlaps(table(spark, folder, "synthetic_records"), "document_id", "full_text", "recommended_split", threshold=threshold, k=k)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = splitoverlap.overlap_pairs(*_overlaps(spark, folder, 0.7, 3))
    return pairs.select(F.least("train_id", "held_id").alias("document_id_a"), F.greatest("train_id", "held_id").alias("document_id_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per held-out split and source_system: records that overlap with training texts (five words, 0.8)."""
    hit = splitoverlap.overlapping_held_out(*_overlaps(spark, folder, 0.8, 5))
    source = table(spark, folder, "synthetic_records").where("document_id is not null").groupBy(F.col("document_id").alias("id"), normal("recommended_split").alias("split")).agg(F.min(normal("source_system")).alias("source_system"))
    return source.join(hit, ["id", "split"]).groupBy("split", "source_system").agg(F.count(F.lit(1)).alias("records"), F.sum("texts").alias("training_texts"), F.sum("copies").alias("training_records"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_classes, p5_found, p5_report, p5_sample, p6_found, p6_report)}


def _shingled(columns: str, where: str) -> str:
    """All runs of three words of every record, and their numbers: for comparing all with all."""
    return rf"""WITH w AS (SELECT DISTINCT document_id, {columns}, regexp_extract_all(lower(full_text), '[\p{{L}}\p{{N}}]+') AS w FROM synthetic_records WHERE document_id IS NOT NULL AND full_text IS NOT NULL AND {where}),
        s AS (SELECT DISTINCT document_id, label, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT document_id, label, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        n AS (SELECT document_id, label, count(*) AS n FROM s GROUP BY ALL)"""


def _similar(condition: str) -> str:
    return f"""p AS (SELECT a.document_id AS a, b.document_id AS b, a.label AS la, b.label AS lb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND {condition} GROUP BY ALL)
        SELECT DISTINCT least(a, b) AS document_id_a, greatest(a, b) AS document_id_b FROM p JOIN n x ON x.document_id = a AND x.label = la JOIN n y ON y.document_id = b AND y.label = lb WHERE a <> b AND c >= 0.7 * (x.n + y.n - c) - 1e-9"""


def oracle_sql() -> dict[str, str]:
    needed = "greatest(coalesce(t.min_rows, 0), floor(t.target_share * s.size + 0.5 + 1e-9))"
    one = "SELECT request_id, min_by({f}, received_at) AS v FROM generation_requests WHERE request_id IS NOT NULL GROUP BY request_id"
    counts = " UNION ALL ".join(f"SELECT '{f}' AS field, lower(trim(v)) AS category, count(*) AS n FROM ({one.format(f=f)}) GROUP BY ALL" for f in FIELDS)
    splits = "lower(trim(recommended_split))"
    return {
        "p1_found": _shingled("scenario_type AS label", "scenario_type IS NOT NULL") + ", " + _similar("a.label = b.label AND a.document_id < b.document_id"),
        "p6_found": _shingled(f"{splits} AS label", f"{splits} IN ('train', 'validation', 'test')") + ", " + _similar("a.label = 'train' AND b.label <> 'train'"),
        "p5_found": f"""
            WITH s AS (SELECT floor(count(DISTINCT request_id) / 2) AS size FROM generation_requests),
            c AS ({counts})
            SELECT t.field, t.category FROM sample_targets t CROSS JOIN s LEFT JOIN c ON c.field = t.field AND c.category = t.category
            WHERE coalesce(c.n, 0) < {needed}"""
    }
