"""Bringing older datasets to the current schema: missing columns, ids, inferred labels, order of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.functions.materialize import cut
from veilspark.operators.decide import ordered, with_defaults
from veilspark.schemas import DATASET_COLUMNS


def with_ids(df: DataFrame, id_col: str, order: Column) -> DataFrame:
    """Blank ids become DOC-0001 and so on by the row's place in ``order``."""
    # Range partitions keep the order without one task sorting all; written once, as both uses must see the same ones.
    ranged = cut(df.withColumn("_o", order).repartitionByRange("_o").withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_k")).select("_p", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    place = F.col("_n0") + F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    out = ranged.join(F.broadcast(sizes), "_p").withColumn("_place", place)
    return out.withColumn(id_col, F.when(S.is_blank(id_col), F.format_string("DOC-%04d", "_place")).otherwise(F.col(id_col))).drop("_o", "_p", "_n0", "_place")


def upgraded(df: DataFrame) -> DataFrame:
    """The current schema: blank language, scenario, primary type, count and challenge category are inferred."""
    df = with_defaults(df, {c: F.lit("") for c in DATASET_COLUMNS if not c.endswith(("date", "_at", "mb", "count"))} | {c: F.lit(0) for c in ("category_count", "pii_count")})
    labels = S.active_labels()
    df = df.withColumns(
        {
            "language": S.infer_language("language", "full_text"),
            "scenario_type": S.infer_scenario("scenario_type", "document_type", "file_name", "full_text"),
            "primary_pii_type": S.infer_primary("primary_pii_type", labels),
            "pii_count": S.infer_count("pii_count", "category_count", labels),
            "challenge_category": S.infer_challenge("challenge_category", "edge_case", "labeling_notes", "full_text"),
        }
    )
    return ordered(df, list(DATASET_COLUMNS))


def preview(df: DataFrame, text_col: str) -> DataFrame:
    """Line breaks written as two signs, so each row is one line."""
    text = F.col(text_col)
    for old, new in (("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return df.withColumn(text_col, text)
