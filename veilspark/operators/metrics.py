"""Confusion counts and what follows from them, in one aggregate for any number of stages, labels and groups.

Counts come from two booleans. A ratio with nothing under it is 0.0; results are rounded as reports show them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scalars import ENTITY_LABELS, norm_bool, safe_divide, safe_sum

STAGES = {"standardized": "predicted_pii", "sweep1_strong": "detected_pii", "sweep1_any": "detected_any_pii", "sweep2_llm": "llm_pii", "final": "final_pii"}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counts(truth: Column, predicted: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(truth & predicted).alias("TP"), F.count_if(~truth & ~predicted).alias("TN"), F.count_if(~truth & predicted).alias("FP"), F.count_if(truth & ~predicted).alias("FN")]


def with_scores(df: DataFrame, digits: int = 4) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to a table with TP, TN, FP and FN."""
    tp, tn, fp, fn = (F.col(c) for c in ("TP", "TN", "FP", "FN"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({"accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), digits), "precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(ratio(2 * p * r, p + r), digits)})


def truth_column(df: DataFrame) -> str:
    for name in ("ground_truth_pii", "contains_personal_data"):
        if name in df.columns:
            return name
    raise ValueError("the table has neither ground_truth_pii nor contains_personal_data")


def binary(df: DataFrame, truth: Column, predicted: Column, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """One line for the table or for each group."""
    return with_scores((df.groupBy(*by) if by else df).agg(*counts(truth, predicted)), digits)


def stage_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A line for each stage whose prediction column is there; the reviewer's stage counts reviewed rows only."""
    truth = norm_bool(truth_column(df))
    parts = []
    for stage, c in STAGES.items():
        if c in df.columns:
            asked = norm_bool("needs_llm_review") if c == "llm_pii" and "needs_llm_review" in df.columns else F.lit(True)
            parts.append(F.when(asked, F.struct(F.lit(stage).alias("stage"), norm_bool(c).alias("predicted"))))
    long = df.select(*by, truth.alias("truth"), F.explode(F.array_compact(F.array(*parts))).alias("s")).select(*by, "truth", "s.*")
    return binary(long, F.col("truth"), F.col("predicted"), (*by, "stage"))


def entity_metrics(df: DataFrame, scores: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """A line for each label with a truth column: the label is predicted if the map of scores has it."""
    labels = [x for x in ENTITY_LABELS if f"{x}_yes_no" in df.columns]
    parts = F.array(*[F.struct(F.lit(x).alias("entity"), norm_bool(f"{x}_yes_no").alias("truth")) for x in labels])
    scores = F.coalesce(scores, F.create_map().cast("map<string,double>"))
    long = df.select(*by, scores.alias("_scores"), F.explode(parts).alias("e")).select(*by, "e.*", F.map_contains_key(F.col("_scores"), F.col("e.entity")).alias("predicted"))
    return binary(long, F.col("truth"), F.col("predicted"), (*by, "entity"))


def tidy(stages: DataFrame, entities: DataFrame) -> DataFrame:
    """Both tables under each other with metric_group and metric_name."""
    a = stages.withColumn("metric_group", F.lit("document")).withColumnRenamed("stage", "metric_name")
    return a.unionByName(entities.withColumn("metric_group", F.lit("entity")).withColumnRenamed("entity", "metric_name"))


def single_value(column: str) -> Column:
    """Aggregate: the column's value where all rows share one, else null."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


def routing(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents in all, sent to review and settled locally, with rates."""
    flag = norm_bool("needs_review" if "needs_review" in df.columns else "needs_llm_review")
    out = (df.groupBy(*by) if by else df).agg(F.count(F.lit(1)).alias("documents_total"), F.count_if(flag).alias("documents_sent_to_review"))
    local = F.col("documents_total") - F.col("documents_sent_to_review")
    return out.withColumns({"documents_resolved_locally": local, "routing_rate": F.round(safe_divide("documents_sent_to_review", "documents_total"), 4), "local_processing_rate": F.round(safe_divide(local, "documents_total"), 4)})


def usage(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests, tokens, cost and run time of reviewers and scorers; absent columns count as zero."""

    def true(name: str) -> Column:
        return F.count_if(norm_bool(name)) if name in df.columns else F.lit(0)

    tokens = [safe_sum(df, f"llm_{k}_tokens").cast("long").alias(f"llm_{k}_tokens") for k in ("prompt", "completion", "total", "reasoning", "cached")]
    return (df.groupBy(*by) if by else df).agg(
        true("needs_llm_review").alias("llm_requests_attempted"), true("llm_request_success").alias("llm_requests_successful"), *tokens, F.round(safe_sum(df, "llm_request_cost"), 8).alias("llm_reported_cost"),
        true("needs_bert_review").alias("bert_requests_attempted"), true("bert_request_success").alias("bert_requests_successful"), F.round(safe_sum(df, "bert_runtime_seconds"), 4).alias("bert_runtime_seconds"),
    )


def cost_summary(runs: DataFrame, used: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Routing and usage side by side with five ratios; runs without usage have zeros."""
    out = runs.join(used, list(on), "left").na.fill(0)
    return out.withColumns(
        {
            "bert_average_runtime_seconds": safe_divide("bert_runtime_seconds", "bert_requests_successful"),
            "cost_per_document": safe_divide("llm_reported_cost", "documents_total"),
            "cost_per_llm_document": safe_divide("llm_reported_cost", "llm_requests_successful"),
            "tokens_per_llm_document": safe_divide("llm_total_tokens", "llm_requests_successful"),
            "reasoning_token_ratio": safe_divide("llm_reasoning_tokens", "llm_completion_tokens"),
        }
    )


def benchmark(metric_rows: DataFrame) -> DataFrame:
    """The rows of the standard prediction of each output, best first."""
    rows = metric_rows.where((F.col("metric_group") == "document") & (F.col("metric_name") == "standardized"))
    return rows.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"))


def recoverable_recall(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives that neither are decided nor go to review are lost; what is left is the recall."""
    truth = norm_bool(truth_column(df))
    routed = norm_bool("needs_llm_review") if "needs_llm_review" in df.columns else F.lit(False)
    decided = norm_bool("detected_pii" if "detected_pii" in df.columns else "predicted_pii")
    out = (df.groupBy(*by) if by else df).agg(F.count_if(truth & ~decided & ~routed).alias("lost"), F.count_if(truth).alias("n_positive"), F.avg(routed.cast("double")).alias("routed"))
    return out.withColumn("recall", 1 - F.col("lost") / F.greatest("n_positive", F.lit(1)))
