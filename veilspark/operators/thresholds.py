"""Choosing thresholds of a score: average precision, sweeps, calibration and frontier.

All work on (p, truth). Scores are first aggregated to their distinct values, so the ordered steps see at most
as many rows as there are distinct scores. Operating points are found from ordered prefix counts, without building
the pairs of candidates, so there may be any number of scores. Rows with a null or no number as their score take no
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.materialize import cut
from veilspark.operators.metrics import ratio


def scored(df: DataFrame, p: str, truth: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p, n, pos) for each distinct score."""
    rows = df.select(*by, F.col(p).cast("double").alias("p"), truth.alias("y")).where("p is not null and not isnan(p)")
    return rows.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos"))


def average_precision(df: DataFrame, p: str, truth: Column, order: str) -> DataFrame:
    """One row {average_precision, n, n_positive}: the mean over the positives of the precision at their rank.

    Ranks go by falling score, ties by ``order``. 0.0 without positives or without negatives. Ranks are laid out in
    range-partitioned blocks with the blocks' counts added, so no task sorts the whole table.
    """
    rows = df.select(F.col(p).cast("double").alias("p"), truth.alias("y"), F.col(order).alias("o")).where("p is not null and not isnan(p)")
    rows = rows.withColumn("block", F.floor(F.least(F.greatest((1 - F.col("p")) * 4096, F.lit(0.0)), F.lit(4096.0))))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("bn"), F.count_if("y").alias("bpos"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bpos").over(before), F.lit(0)).alias("tp0"))
    inside = Window.partitionBy("block").orderBy(F.desc("p"), F.asc("o"))
    ranked = rows.join(F.broadcast(sizes), "block").withColumns({"rank": F.col("n0") + F.row_number().over(inside), "tp": F.col("tp0") + F.sum(F.col("y").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = ranked.agg(F.sum(F.when(F.col("y"), F.col("tp") / F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_positive"))
    mixed = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n"))
    return out.select(F.when(mixed, F.col("s") / F.col("n_positive")).otherwise(0.0).alias("average_precision"), "n", "n_positive")


def candidates(points: DataFrame, steps: int = 201, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., t): a grid on [0, 1], the distinct scores and the middles between neighbours."""
    ordered = Window.partitionBy(*by).orderBy("p")
    seen = points.withColumn("_m", (F.col("p") + F.lead("p").over(ordered)) / 2)
    seen = seen.select(*by, F.explode(F.array("p", "_m")).alias("t")).where("t is not null")
    grid = points.select(*by).distinct() if by else points.limit(1).select(F.lit(1).alias("_one"))
    grid = grid.select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / F.lit(steps - 1))).alias("t"))
    return seen.unionByName(grid).select(*by, F.least(F.greatest("t", F.lit(0.0)), F.lit(1.0)).alias("t")).distinct()


def cumulative(points: DataFrame, cands: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., t, n_below, pos_below, n_upto, pos_upto, n, n_pos): counts under and up to each candidate."""
    both = points.select(*by, F.col("p").alias("t"), "n", "pos").unionByName(cands.select(*by, "t", F.lit(0).alias("n"), F.lit(0).alias("pos")))
    sums = both.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    w, whole = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    out = sums.select(*by, "t", F.sum("n").over(w).alias("n_upto"), F.sum("pos").over(w).alias("pos_upto"), F.col("n").alias("_n"), F.col("pos").alias("_pos"), F.sum("n").over(whole).alias("n_all"), F.sum("pos").over(whole).alias("n_pos"))
    out = out.withColumns({"n_below": F.col("n_upto") - F.col("_n"), "pos_below": F.col("pos_upto") - F.col("_pos")}).drop("_n", "_pos")
    return out.join(cands, [*by, "t"])


def sweep(cum: DataFrame) -> DataFrame:
    """Metrics of "p at or over t" for every candidate, rounded to 6 digits."""
    tp, n, pos = F.col("n_pos") - F.col("pos_below"), F.col("n_all"), F.col("n_pos")
    fp = n - F.col("n_below") - tp
    p, r = ratio(tp, tp + fp), ratio(tp, pos)
    return cum.select("t", tp.alias("TP"), fp.alias("FP"), (pos - tp).alias("FN"), (n - pos - fp).alias("TN"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def _positives(points: DataFrame) -> None:
    if not points.agg(F.sum("pos").alias("pos")).first()["pos"]:
        raise ValueError("a recall can't be held on data without positives")


def frontier(df: DataFrame, p: str, truth: Column, recalls: list[float], precision: float, steps: int = 201) -> DataFrame:
    """For each wanted recall the operating point (t_low, t_high), t_high at or over t_low, that routes least.

    Ties go to fewer missed positives, fewer unreviewed false positives, more automatic negatives, then smaller
    t_low and t_high. Where nothing is feasible everything is routed (0, 1).

    Recall depends on t_low only and precision on t_high only. Rows over t_high and false positives among them fall as
    t_high rises, so a t_low routes least with the next t_high that holds the precision. Of the t_low with the least
    routed and missed, the one with the most automatic negatives leaves the most room for a higher t_high at the same
    rounded fraction, so it is also the one with the fewest false positives.
    """
    points = cut(scored(df, p, truth))
    _positives(points)
    cum = cumulative(points, candidates(points, steps))
    yes, tp = F.col("n_all") - F.col("n_upto"), F.col("n_pos") - F.col("pos_upto")
    share = F.when(yes > 0, F.round(tp / yes, 6))
    fits = share.isNull() | (share >= precision)
    down = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    cum = cut(cum.select("t", "n_below", "pos_below", "n_all", "n_pos", yes.alias("yes"), (yes - tp).alias("fp"), share.alias("share"), fits.alias("fits")).withColumns({"next_yes": F.last(F.when(F.col("fits"), F.col("yes")), True).over(down), "n_fits": F.count_if("fits").over(down)}))
    targets = df.sparkSession.createDataFrame([(float(r),) for r in recalls], "recall_target double")

    def routed(over: str) -> Column:
        return F.col("n_all") - F.col("n_below") - F.col(over)

    low = cum.where("n_fits > 0").join(F.broadcast(targets), 1 - F.col("pos_below") / F.col("n_pos") >= F.col("recall_target"))
    first = F.struct(F.round(routed("next_yes") / F.col("n_all"), 6).alias("routed_fraction"), F.col("pos_below").alias("missed"), (-F.col("n_below")).alias("wide"), F.col("t").alias("t_low"))
    low = low.groupBy("recall_target").agg(F.min(first).alias("k"), F.sum("n_fits").alias("n_feasible_points")).select("recall_target", "k.*", "n_feasible_points")
    high = cum.where("fits").drop("n_below").join(F.broadcast(low.withColumn("n_below", -F.col("wide"))), F.col("t") >= F.col("t_low"))
    high = high.where(F.round(routed("yes") / F.col("n_all"), 6) == F.col("routed_fraction"))
    key = F.struct(F.col("fp").alias("auto_yes_fp"), F.col("t").alias("t_high"), routed("yes").alias("routed_n"), F.col("yes").alias("auto_yes_n"), F.col("share").alias("auto_yes_precision"))
    best = high.groupBy("recall_target", "routed_fraction", "missed", "t_low", "n_feasible_points").agg(F.min(key).alias("k"))
    best = best.select("recall_target", "routed_fraction", "missed", "k.auto_yes_fp", "t_low", "k.t_high", "k.routed_n", "k.auto_yes_n", "k.auto_yes_precision", "n_feasible_points")
    out = targets.join(best, "recall_target", "left").withColumn("feasible", F.col("n_feasible_points").isNotNull())
    return out.withColumns({"t_low": F.coalesce("t_low", F.lit(0.0)), "t_high": F.coalesce("t_high", F.lit(1.0)), "n_feasible_points": F.coalesce("n_feasible_points", F.lit(0))})


def calibrate(df: DataFrame, p: str, truth: Column, recall: float, precision: float, steps: int = 201) -> DataFrame:
    """The operating point for one wanted recall."""
    return frontier(df, p, truth, [recall], precision, steps)


def evaluate(df: DataFrame, p: str, truth: Column, t_low: float, t_high: float) -> DataFrame:
    """All metrics of one operating point; scores at the bounds are routed. One aggregate."""
    x = F.col(p).cast("double")
    x = F.when(~F.isnan(x), x)
    no, yes = F.coalesce(x < t_low, F.lit(False)), F.coalesce(x > t_high, F.lit(False))
    routed = ~no & ~yes
    base = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("n_positive"), F.count_if(routed).alias("routed_n"), F.count_if(truth & no).alias("missed_positives"), F.count_if(yes).alias("auto_yes_n"),
        F.count_if(~truth & yes).alias("auto_yes_fp"), F.count_if(no).alias("auto_no_n"), F.count_if(~truth & no).alias("_no_right"), F.count_if(truth & routed).alias("routed_positives"), F.count_if(~truth & routed).alias("routed_negatives"),
    )
    n, pos = F.col("n"), F.col("n_positive")
    out = base.withColumns(
        {
            "t_low": F.lit(float(t_low)), "t_high": F.lit(float(t_high)), "n_negative": n - pos, "routed_fraction": F.round(ratio(F.col("routed_n"), n), 6), "auto_decided_n": n - F.col("routed_n"),
            "llm_call_reduction": F.round(ratio(n - F.col("routed_n"), n), 6), "prefilter_recall": F.when(pos > 0, F.round(1 - F.col("missed_positives") / pos, 6)),
            "auto_yes_precision": F.when(F.col("auto_yes_n") > 0, F.round(1 - F.col("auto_yes_fp") / F.col("auto_yes_n"), 6)), "auto_no_npv": F.when(F.col("auto_no_n") > 0, F.round(F.col("_no_right") / F.col("auto_no_n"), 6)),
        }
    )
    for name, fp in (("oracle", F.col("auto_yes_fp")), ("conservative", F.col("auto_yes_fp") + F.col("routed_negatives"))):
        tp = pos - F.col("missed_positives")
        a, r = ratio(tp, tp + fp), ratio(tp, pos)
        out = out.withColumns({f"{name}_precision": F.round(a, 6), f"{name}_recall": F.round(r, 6), f"{name}_f1": F.round(ratio(2 * a * r, a + r), 6)})
    return out.drop("_no_right")


def label_thresholds(long: DataFrame, default: float = 0.5, steps: int = 201) -> DataFrame:
    """(label, threshold, f1, positives) of a table (label, p, truth): the threshold with the best F1, ties to the
    highest; the default for labels without positives."""
    points = scored(long, "p", F.col("truth"), ("label",))
    cum = cumulative(points, candidates(points, steps, ("label",)), ("label",))
    tp = F.col("n_pos") - F.col("pos_below")
    fp = F.col("n_all") - F.col("n_below") - tp
    a, r = ratio(tp, tp + fp), ratio(tp, F.col("n_pos"))
    best = cum.groupBy("label").agg(F.max(F.struct(F.round(ratio(2 * a * r, a + r), 6).alias("f1"), "t")).alias("b"), F.max("n_pos").alias("positives"))
    some = F.col("positives") > 0
    return best.select("label", F.when(some, F.round("b.t", 6)).otherwise(default).alias("threshold"), F.when(some, F.col("b.f1")).otherwise(0.0).alias("f1"), "positives")


def histogram(df: DataFrame, p: str, by: tuple[str, ...] = (), bins: int = 40) -> DataFrame:
    """(by..., bin, n) on [0, 1]; the last bin holds 1."""
    x = F.col(p).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    return rows.groupBy(*by, F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
