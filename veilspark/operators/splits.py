"""Dataset exploration and duplicate-aware splits.

Texts that differ in white space and case only are one group; a group is never cut by a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.columns import normal
from veilspark.functions.scalars import ENTITY_LABELS, norm_bool, text_key, token_estimate

SPLITS = ("train", "validation", "test")
MAX_LENGTHS, TRUNCATION_TOLERANCE = (128, 256, 384, 512), 0.02


def crosstab(df: DataFrame, column: str, truth: Column) -> DataFrame:
    """n, positives, negatives and rate per value, most frequent first; null values are left out."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("positives"))
    return out.withColumns({"negatives": F.col("n") - F.col("positives"), "positive_rate": F.round(F.col("positives") / F.col("n"), 4)}).orderBy(F.desc("n"), column)


def crosstabs(df: DataFrame, columns: list[str], truth: Column) -> DataFrame:
    """(column, value, n, positives, negatives, positive_rate) of several columns in one pass."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(truth.alias("truth"), F.explode(parts).alias("c")).select("truth", "c.*").where("value is not null")
    out = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("positives"))
    return out.withColumns({"negatives": F.col("n") - F.col("positives"), "positive_rate": F.round(F.col("positives") / F.col("n"), 4)})


def length_stats(df: DataFrame, text_col: str) -> DataFrame:
    """Exact quantiles of text lengths, cut to whole numbers, and the share of texts that each limit would cut.

    Null texts count as length 0. The recommended limit is the first that cuts at most TRUNCATION_TOLERANCE of the
    texts, else the largest. Lengths are counted first, so quantiles are taken over distinct lengths.
    """
    n = df.select(F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("k"))
    q = lambda p: F.percentile(F.col("len"), F.lit(p), F.col("k")).cast("int")
    tokens, total = F.col("len") / 3.5, F.sum("k")
    over = {m: F.round(F.sum(F.when(tokens > m, F.col("k")).otherwise(0)) / total, 4) for m in MAX_LENGTHS}
    raw = {m: F.sum(F.when(tokens > m, F.col("k")).otherwise(0)) / total for m in MAX_LENGTHS}
    best = None
    for m in MAX_LENGTHS[:-1]:
        best = F.when(raw[m] <= TRUNCATION_TOLERANCE, m) if best is None else best.when(raw[m] <= TRUNCATION_TOLERANCE, m)
    return n.agg(
        F.min("len").cast("int").alias("min"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("len").cast("int").alias("max"), (F.max("len") / 3.5).cast("int").alias("max_tokens"),
        F.percentile(tokens, F.lit(0.95), F.col("k")).cast("int").alias("p95_tokens"), *[v.alias(f"truncated_at_{m}") for m, v in over.items()], best.otherwise(MAX_LENGTHS[-1]).alias("recommended_max_length"),
    )


def duplicate_groups(df: DataFrame, text_col: str, split_col: str | None = None) -> DataFrame:
    """(key, n, splits) of every group of equal texts."""
    splits = F.count_distinct(F.col(split_col)) if split_col else F.lit(None).cast("long")
    return df.groupBy(text_key(text_col).alias("key")).agg(F.count(F.lit(1)).alias("n"), splits.alias("splits"))


def duplicate_stats(df: DataFrame, text_col: str, split_col: str) -> DataFrame:
    g = duplicate_groups(df, text_col, split_col)
    more = F.col("n") > 1
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.count(F.lit(1)).alias("n_unique_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicated_rows"), F.count_if(more).alias("n_duplicate_groups"), F.coalesce(F.max(F.when(more, F.col("n"))), F.lit(0)).alias("largest_duplicate_group"), F.count_if(F.col("splits") > 1).alias("duplicate_groups_spanning_splits"))


def stratified_split(df: DataFrame, text_col: str, truth: Column, validation: float = 0.15, test: float = 0.15, seed: int = 42, order: Column | None = None) -> DataFrame:
    """(key, positive, split) of every group of equal texts.

    Groups of each stratum (any member positive, or none) are put in the order of a hash and dealt one by one to the
    split that has least of its share, ties by name. The deal depends on a group's rank alone, so ranks are laid
    out by blocks of the hash and no stratum is sorted in one task. Where the shares are fractions of small whole
    numbers the split is looked up in one period of the deal, else it is computed from the rank.
    """
    if not (0 < validation < 1 and 0 < test < 1 and validation + test < 1):
        raise ValueError("the shares of validation and test must be in (0, 1) and leave room for training")
    groups = df.select(text_key(text_col).alias("key"), truth.alias("y")).groupBy("key").agg(F.bool_or("y").alias("positive"))
    groups = groups.withColumn("o", F.xxhash64("key", F.lit(seed)) if order is None else order).withColumn("block", F.shiftright("o", 52))
    sizes = groups.groupBy("positive", "block").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("positive").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("positive", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("n0"))
    rank = F.col("n0") + F.row_number().over(Window.partitionBy("positive", "block").orderBy("o", "key")) - 1
    ranked = groups.join(F.broadcast(sizes), ["positive", "block"]).withColumn("rank", rank)
    shares = {"train": 1.0 - validation - test, "validation": validation, "test": test}
    if (deal := deal_order(shares)) is None:
        return ranked.select("key", "positive", dealt(F.col("rank"), shares).alias("split"))
    period = F.array(*[F.lit(d) for d in deal])
    return ranked.select("key", "positive", F.element_at(period, (F.pmod("rank", F.lit(len(deal))) + 1).cast("int")).alias("split"))


def dealt(rank: Column, shares: dict[str, float]) -> Column:
    """Who gets the card of a rank, whatever the shares.

    The j-th card of a split is dealt when others have fewer cards than j times their share over its own, so its
    place in the deal is a sum of whole numbers; the split with a card at this place is the answer.
    """
    out = None
    for s, f in shares.items():
        for d in (-2, -1, 0, 1, 2):
            j = F.floor(rank * f) + d
            place = j
            for other, g in shares.items():
                if other != s:
                    due = F.round(j * (g / f), 9)
                    place = place + F.ceil(due) + (F.when(due == F.ceil(due), 1).otherwise(0) if other < s else F.lit(0))
            hit = (j >= 0) & (place == rank)
            out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def deal_order(shares: dict[str, float], most: int = 2_000) -> list[str] | None:
    """One period of dealing cards to whoever has least of their share, ties by name; None where it is longer."""
    period = next((k for k in range(1, most + 1) if all(abs(k * s - round(k * s)) < 1e-9 for s in shares.values())), None)
    if period is None:
        return None
    counts, out = dict.fromkeys(shares, 0.0), []
    for _ in range(period):
        chosen = min((round(counts[s] / max(f, 1e-9), 9), s) for s, f in shares.items())[1]
        counts[chosen] += 1
        out.append(chosen)
    return out


def with_split(df: DataFrame, text_col: str, assigned: DataFrame) -> DataFrame:
    return df.withColumn("key", text_key(text_col)).join(assigned.select("key", F.col("split").alias("assigned_split")), "key").drop("key")


def split_report(df: DataFrame, split_col: str, truth: Column) -> DataFrame:
    """n, positives, rate and usable per split: a split needs both classes."""
    out = df.where(F.col(split_col).isNotNull()).groupBy(normal(split_col).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("positives"))
    return out.withColumns({"positive_rate": F.round(F.col("positives") / F.col("n"), 4), "usable": (F.col("positives") > 0) & (F.col("positives") < F.col("n"))})


def resolve_split(df: DataFrame, split_col: str, truth: Column, strategy: str = "auto") -> str:
    """"recommended" if all three splits are there with both classes, else "stratified"; a wish that can't be met is
    an error."""
    if strategy not in ("auto", "recommended", "stratified"):
        raise ValueError(f"unknown strategy {strategy!r}")
    good = split_col in df.columns and {r["split"] for r in split_report(df, split_col, truth).where("usable").collect()} >= set(SPLITS)
    if strategy == "recommended" and not good:
        raise ValueError("the recommended splits don't all hold both classes")
    return "recommended" if strategy != "stratified" and good else "stratified"


def class_weights(df: DataFrame, truth: Column, cap: float = 20.0) -> DataFrame:
    """(label, positives, n, rate, pos_weight) of the document label and of each entity label; weights are capped,
    those of entities at least 1; without positives the weight is the cap."""
    labels = [x for x in ENTITY_LABELS if f"{x}_yes_no" in df.columns]
    parts = F.array(F.struct(F.lit("DOCUMENT").alias("label"), truth.alias("y")), *[F.struct(F.lit(x).alias("label"), norm_bool(f"{x}_yes_no").alias("y")) for x in labels])
    n = df.select(F.explode(parts).alias("l")).groupBy("l.label").agg(F.count_if("l.y").alias("positives"), F.count(F.lit(1)).alias("n"))
    raw = F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives")).otherwise(cap)
    w = F.least(raw, F.lit(float(cap)))
    return n.withColumns({"rate": F.round(F.col("positives") / F.col("n"), 4), "pos_weight": F.round(F.when(F.col("label") == "DOCUMENT", w).otherwise(F.greatest(w, F.lit(1.0))), 4)})


def gaps(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row with the differences between splits: train minus validation and validation minus test."""
    wide = scores.groupBy().pivot("split", list(SPLITS)).agg(*[F.max(m).alias(m) for m in metrics])
    col = lambda s, m: F.col(f"{s}_{m}" if len(metrics) > 1 else s)
    return wide.select(*[F.round(col(a, m) - col(b, m), 6).alias(f"{x}_minus_{y}_{m}") for m in metrics for a, b, x, y in (("train", "validation", "train", "val"), ("validation", "test", "val", "test"))])


def read_gaps(row: DataFrame, scores: DataFrame, flag_at: float = 0.05, easy: float = 0.99) -> DataFrame:
    """Flags that follow from the gaps; all scores near perfect without a gap mean that the data is too easy."""
    least = scores.agg(F.min("f1").alias("least_f1"))
    a, b, r = (F.col(c) for c in ("train_minus_val_f1", "val_minus_test_f1", "val_minus_test_prefilter_recall"))
    over, calib = F.coalesce(a >= flag_at, F.lit(False)), F.coalesce(b >= flag_at, F.lit(False)) | F.coalesce(r >= flag_at, F.lit(False))
    small = F.coalesce(F.abs(a) < flag_at, F.lit(True)) & F.coalesce(F.abs(b) < flag_at, F.lit(True)) & (a.isNotNull() | b.isNotNull())
    flags = F.array_compact(F.array(F.when(over, "train_val_overfit"), F.when(calib, "val_test_calibration_gap"), F.when(small & (F.col("least_f1") >= easy), "dataset_too_easy")))
    return row.crossJoin(F.broadcast(least)).withColumn("flags", flags)


def estimated_tokens(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("tokens_estimated", token_estimate(text_col))
