"""Comparing runs, and projections of results for other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scalars import ENTITY_LABELS, norm_bool
from veilspark.operators.decide import with_metadata, Strategy

#: Columns of the comparison, and the place of each in a run's summary.
COLUMNS = {
    "run": "name", "model": "config.model_name", "split_mode": "summary.split_mode", "max_length": "config.max_length", "selected_epoch": "summary.selected_epoch",
    "val_accuracy": "summary.validation.accuracy", "val_precision": "summary.validation.precision", "val_recall": "summary.validation.recall", "val_f1": "summary.validation.f1", "val_pr_auc": "summary.validation.pr_auc",
    "routed_fraction": "calibration.routed_fraction", "prefilter_recall": "calibration.prefilter_recall", "missed_positives": "calibration.missed_positives", "t_low": "calibration.t_low", "t_high": "calibration.t_high",
    "training_seconds": "summary.training_seconds", "model_size_mb": "summary.model_size_mb",
}
SUMMARY_DDL = (
    "name string, config struct<model_name:string,max_length:int>, calibration struct<routed_fraction:double,prefilter_recall:double,missed_positives:long,t_low:double,t_high:double>, "
    "summary struct<split_mode:string,selected_epoch:int,training_seconds:double,model_size_mb:double,splits:array<struct<split:string,n:long>>,validation:struct<accuracy:double,precision:double,recall:double,f1:double,pr_auc:double>>"
)


def comparison(runs: DataFrame) -> DataFrame:
    """One line for each run (SUMMARY_DDL): its model, size of data, scores and operating point. What a run doesn't
    say is null; a run without splits has 0 documents."""
    documents = F.aggregate(F.coalesce("summary.splits", F.array().cast("array<struct<split:string,n:long>>")), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["n"], F.lit(0)))
    return runs.select(*[F.col(path).alias(c) for c, path in COLUMNS.items()], documents.alias("documents"))


def zero_filled(df: DataFrame, keys: Sequence[str], column: str, domain: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys..., column, values...): a line for each value of a fixed domain under every key, 0 where there is none."""
    wanted = df.select(*keys).distinct().withColumn(column, F.explode(F.array(*map(F.lit, domain))))
    return wanted.join(df.select(*keys, column, *values), [*keys, column], "left").na.fill(0, list(values))


def parameters(df: DataFrame, names: Sequence[str]) -> Column:
    """A map of the run's parameters as text; absent columns and nulls are left out."""
    parts = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names if c in df.columns]
    return F.map_from_entries(F.filter(F.array(*parts), lambda p: p["value"].isNotNull())) if parts else F.create_map().cast("map<string,string>")


def numbers(df: DataFrame, names: Sequence[str]) -> Column:
    """A map of the metrics that are numbers; absent columns, nulls and other text are left out."""
    parts = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").try_cast("double").alias("value")) for c in names if c in df.columns]
    return F.map_from_entries(F.filter(F.array(*parts), lambda p: p["value"].isNotNull() & ~F.isnan(p["value"]))) if parts else F.create_map().cast("map<string,double>")


def tracked(df: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(run, params, metrics) of each benchmark row, as trackers of experiments take them."""
    return df.select(F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run"), parameters(df, params).alias("params"), numbers(df, metrics).alias("metrics"))


def write_tracked(rows: DataFrame, path: str) -> None:
    """Tracked rows as JSON lines, a folder for each run, for a tracker to pick up."""
    rows.withColumn("run", F.when(F.col("run") == "", "unnamed").otherwise(F.col("run"))).write.mode("overwrite").partitionBy("run").json(path)


SWEEP_COLUMNS = ("entities", "per_type_conf", "detected_categories", "strong_pii_categories", "potential_pii_categories", "detected_pii", "detected_any_pii", "has_person_hint", "route", "routing_reason", "needs_llm_review")


def sweep_baseline(source: DataFrame, swept: DataFrame, run_id: str, inference_ms: float, id_col: str = "document_id", context: Sequence[str] = ("language", "scenario_type", "difficulty", "challenge_category", "recommended_split")) -> DataFrame:
    """The first sweep alone as an output that can be evaluated: truth, context, its columns, and predicted_pii."""
    labels = [f"{e}_yes_no" for e in ENTITY_LABELS if f"{e}_yes_no" in source.columns]
    keep = [id_col, "contains_personal_data", *labels, *[c for c in context if c in source.columns]]
    found = swept.select(id_col, *[c for c in SWEEP_COLUMNS if c in swept.columns])
    out = source.select(*keep).join(found, id_col).withColumn("inference_ms", F.round(F.lit(float(inference_ms)), 4))
    return with_metadata(out.withColumn("final_pii", norm_bool("detected_pii")), Strategy("sweep1", "rules", prediction_source="rules"), run_id)
