"""Audits of a dataset against its manifest and rules. Every check is a DataFrame of findings (check, level, count).

A finding's level is PASS where the count is 0, else the check's own level; the audit's status is the worst one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.columns import normal
from veilspark.functions.scalars import ENTITY_LABELS, active_labels, is_blank, is_yes, label_list, norm_bool, safe_int
from veilspark.operators.detect import IDENTIFIERS
from veilspark.operators.splits import SPLITS

# Targets that datasets must reach.
LEVELS = ("PASS", "WARN", "FAIL")
LEAST_EXAMPLES, PRIORITY_TARGETS = 3, {"train": 40, "validation": 10, "test": 10}
PRIORITY = ("IBAN_CODE", "CREDIT_CARD", "MEDICAL_LICENSE", "PHONE_NUMBER", "IP_ADDRESS", "NRP", "URL", "PASSPORT")


def finding(df: DataFrame, check: str, level: str) -> DataFrame:
    """One row of a one-row table (count)."""
    return df.select(F.lit(check).alias("check"), F.when(F.col("count") > 0, level).otherwise("PASS").alias("level"), F.col("count").cast("long").alias("count"))


def status(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0)
    return findings.agg(F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("status"), F.count_if(rank == 2).alias("failures"), F.count_if(rank == 1).alias("warnings"))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, n) of ids that occur more than once; null ids don't count."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def id_differences(data: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """(id, missing_in) of ids that only one of the tables has."""
    a, b = (t.where(F.col(id_col).isNotNull()).select(id_col).distinct() for t in (data, manifest))
    return a.join(b, id_col, "left_anti").withColumn("missing_in", F.lit("manifest")).unionByName(b.join(a, id_col, "left_anti").withColumn("missing_in", F.lit("dataset")))


def aligned(data: DataFrame, manifest: DataFrame, id_col: str, fields: list[str], strict: bool = False) -> DataFrame:
    """(id, field, dataset_value, manifest_value) where a field differs; two nulls agree.

    ``strict`` makes repeated ids an error; otherwise every pair of rows with the id is compared once.
    """
    if strict and (repeated_ids(data, id_col).limit(1).count() or repeated_ids(manifest, id_col).limit(1).count()):
        raise ValueError("ids repeat, so rows can't be matched one to one")
    both = data.select(id_col, *[F.col(f).cast("string").alias(f"d_{f}") for f in fields]).join(manifest.select(id_col, *[F.col(f).cast("string").alias(f"m_{f}") for f in fields]), id_col)
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("dataset_value"), F.col(f"m_{f}").alias("manifest_value")) for f in fields])
    return both.select(id_col, F.explode(parts).alias("p")).select(id_col, "p.*").where(~F.col("dataset_value").eqNullSafe(F.col("manifest_value"))).distinct()


def unknown_values(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(value, n) of values outside the domain, nulls included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("value").isNull() | ~F.col("value").isin(*known))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.when(is_blank(column), "MISSING").otherwise(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def row_violations(df: DataFrame) -> DataFrame:
    """(check, count) of rows that contradict themselves, all rules in one pass."""
    labels = active_labels()
    n, positive = F.size(labels), is_yes("contains_personal_data")
    primary = F.upper(F.coalesce(F.trim("primary_pii_type"), F.lit("")))
    listed = label_list("personal_data_categories")
    rules = {
        "positive_without_labels": positive & (n == 0),
        "negative_with_labels": ~positive & (n > 0),
        "primary_type_differs": primary != F.when(n == 0, "NONE").when(n == 1, F.get(labels, F.lit(0))).otherwise("MULTIPLE"),
        "category_count_differs": ~safe_int("category_count").eqNullSafe(n),
        "pii_count_differs": ~safe_int("pii_count").eqNullSafe(n),
        "categories_differ": ~listed.eqNullSafe(F.array_sort(labels)),
    }
    wide = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("count")) for k in rules])).alias("r")).select("r.*")


def leaking_negatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, identifiers) of rows labelled as without personal data whose text holds an identifier."""
    kinds = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(k)) for k, p in IDENTIFIERS.items()]))
    return df.where(~is_yes("contains_personal_data")).select(id_col, kinds.alias("identifiers")).where(F.size("identifiers") > 0)


def repeated_texts(data: DataFrame, manifest: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_md5, n, intended) of texts that several rows share; intended if all their variants are blank forms."""
    variants = manifest.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_and(F.coalesce(F.lower("variant") == "blank", F.lit(False))).alias("blank"))
    rows = data.where(F.col(text_col).isNotNull()).select(id_col, F.md5(text_col).alias("text_md5")).join(variants, id_col, "left")
    return rows.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("blank", F.lit(False))).alias("intended")).where("n > 1")


def label_support(df: DataFrame, split_col: str) -> DataFrame:
    """(entity, split, positives, target, state) of every label and split: zero, below or ok."""
    parts = F.array(*[F.struct(F.lit(x).alias("entity"), norm_bool(f"{x}_yes_no").alias("y")) for x in ENTITY_LABELS])
    got = df.select(normal(split_col).alias("split"), F.explode(parts).alias("e")).where("e.y").groupBy("e.entity", "split").agg(F.count(F.lit(1)).alias("positives"))
    goals = df.sparkSession.createDataFrame([(x, s, PRIORITY_TARGETS[s] if x in PRIORITY else LEAST_EXAMPLES) for x in ENTITY_LABELS for s in SPLITS], "entity string, split string, target int")
    out = goals.join(got, ["entity", "split"], "left").na.fill(0, ["positives"])
    return out.withColumn("state", F.when(F.col("positives") == 0, "zero").when(F.col("positives") < F.col("target"), "below").otherwise("ok"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Rows per pair of labels, one column a value."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def missing_cells(df: DataFrame, row: str, column: str, rows: list[str], values: list[str]) -> DataFrame:
    """(row, column) of pairs in the domain that no row has."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(a, b) for a in rows for b in values], f"`{row}` string, `{column}` string")
    return domain.join(df.select(row, column).distinct(), [row, column], "left_anti")


def audit(data: DataFrame, manifest: DataFrame, id_col: str, text_col: str, domains: dict[str, list[str]], required: list[str], strict: bool = False) -> DataFrame:
    """All findings. With required columns missing only that is reported; ``strict`` makes warnings of repeated texts
    and thin labels failures."""
    spark = data.sparkSession
    gone = missing_columns(data, required)
    if gone:
        return spark.createDataFrame([(f"missing_column_{c}", "FAIL", 1) for c in gone], "check string, level string, count long")
    soft = "FAIL" if strict else "WARN"
    one = lambda df: df.agg(F.count(F.lit(1)).alias("count"))
    out = [
        finding(one(repeated_ids(data, id_col)), "repeated_ids", "FAIL"),
        finding(one(repeated_ids(manifest, id_col)), "repeated_manifest_ids", "FAIL"),
        finding(one(id_differences(data, manifest, id_col)), "id_differences", "FAIL"),
        finding(one(aligned(data, manifest, id_col, ["scenario_type", "language"])), "differing_fields", "FAIL"),
        finding(one(leaking_negatives(data, id_col, text_col)), "identifiers_in_negatives", "WARN"),
        finding(one(repeated_texts(data, manifest, id_col, text_col).where("not intended")), "repeated_texts", soft),
        finding(one(label_support(data, "recommended_split").where("state <> 'ok'")), "thin_labels", soft),
        *[finding(one(unknown_values(data, c, known)), f"unknown_{c}", "FAIL") for c, known in domains.items()],
        row_violations(data).select("check", F.when(F.col("count") > 0, "FAIL").otherwise("PASS").alias("level"), "count"),
    ]
    return reduce(DataFrame.unionByName, out)


def render(findings: list, title: str = "Audit") -> str:
    """A report's text from collected findings (a few dozen rows)."""
    worst = max((LEVELS.index(r["level"]) for r in findings), default=0)
    return "\n".join([f"{title}: {LEVELS[worst]}", *[f"[{r['level']}] {r['check']}: {r['count']}" for r in sorted(findings, key=lambda r: (-LEVELS.index(r["level"]), r["check"]))]])
