"""Error analysis: types of errors, their shares by any keys, and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.scalars import ENTITY_LABELS, norm_bool
from veilspark.operators.metrics import truth_column

ERROR_TYPES = ("TP", "TN", "FP", "FN")
KEY_SETS = {
    "per_run": ("run_id",),
    "per_primary_type": ("primary_pii_type",),
    "per_language": ("language",),
    "per_challenge": ("challenge_category",),
    "per_scenario": ("scenario_type",),
    "per_model": ("provider", "model_family", "model_name"),
    "per_prediction_source": ("prediction_source",),
    "per_strategy": ("strategy",),
}


def error_type(truth: Column, predicted: Column) -> Column:
    return F.when(truth & predicted, "TP").when(~truth & ~predicted, "TN").when(predicted, "FP").otherwise("FN")


def typed(df: DataFrame, predicted: str = "predicted_pii") -> DataFrame:
    """Adds error_type and is_correct."""
    if predicted not in df.columns:
        raise ValueError(f"no column {predicted}")
    t = error_type(norm_bool(truth_column(df)), norm_bool(predicted))
    return df.withColumn("error_type", t).withColumn("is_correct", F.col("error_type").isin("TP", "TN"))


def summary(df: DataFrame) -> DataFrame:
    """Count and share of each error type."""
    n = df.groupBy("error_type").agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 4))


def grouped(df: DataFrame, key_sets: dict[str, tuple[str, ...]] = KEY_SETS) -> DataFrame:
    """(summary, key, error_type, count, share) for all sets of keys at once, by one pass with GROUPING SETS.

    Sets with a column that isn't there are left out, as are rows with a null in a key. A share is that of the
    key's rows.
    """
    sets = {k: v for k, v in key_sets.items() if all(c in df.columns for c in v)}
    keys = list(dict.fromkeys(c for v in sets.values() for c in v))
    ids = [F.grouping(c).alias(f"_g_{c}") for c in keys]
    n = df.select(*keys, "error_type").groupingSets([[*[F.col(c) for c in v], F.col("error_type")] for v in sets.values()], *keys, "error_type").agg(F.count(F.lit(1)).alias("count"), *ids)
    name = None
    for k, v in sets.items():
        mine = F.lit(True)
        for c in keys:
            mine = mine & (F.col(f"_g_{c}") == (0 if c in v else 1))
        whole = mine
        for c in v:
            whole = whole & F.col(c).isNotNull()
        name = F.when(whole, k) if name is None else name.when(whole, k)
    out = n.withColumn("summary", name).where("summary is not null").withColumn("key", F.concat_ws(" | ", *[F.col(c).cast("string") for c in keys]))
    return out.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("summary", "key")), 4)).select("summary", "key", "error_type", "count", "share")


def slices(df: DataFrame, column: str, truth: Column, predicted: Column, routed: Column, p: str = "pii_probability") -> DataFrame:
    """Errors and routing by one column; null keys are left out. Recall counts routed positives as found and is null
    without positives."""
    p_ = F.col(p)
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("positives"), F.count_if(truth == predicted).alias("correct"), F.count_if(~truth & predicted).alias("false_positives"), F.count_if(truth & ~predicted).alias("false_negatives"),
        F.count_if(truth & ~predicted & ~routed).alias("missed_positives"), F.count_if(~truth & predicted & ~routed).alias("unreviewed_fp"), F.count_if(routed).alias("routed"), F.round(F.avg(F.when(~F.isnan(p_), p_)), 4).alias("mean_probability"),
    )
    return out.withColumns({"accuracy": F.round(F.col("correct") / F.col("n"), 4), "routing_rate": F.round(F.col("routed") / F.col("n"), 4), "recall": F.when(F.col("positives") > 0, F.round((F.col("positives") - F.col("missed_positives")) / F.col("positives"), 4))})


def entity_slices(df: DataFrame) -> DataFrame:
    """(entity, n, positives, predicted, correct): truth and prediction columns of each label side by side."""
    labels = [x for x in ENTITY_LABELS if f"{x}_yes_no" in df.columns and f"{x}_predicted" in df.columns]
    parts = F.array(*[F.struct(F.lit(x).alias("entity"), norm_bool(f"{x}_yes_no").alias("truth"), norm_bool(f"{x}_predicted").alias("predicted")) for x in labels])
    long = df.select(F.explode(parts).alias("e")).select("e.*")
    return long.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("positives"), F.count_if("predicted").alias("predicted_n"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"))
