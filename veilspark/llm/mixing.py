"""Mixing sources to target weights of the total number of tokens.

Tokens are summed per source; a source's rate is what its target needs over what it has, at most its largest
number of uses. Every document is given floor(rate) times and once more with the probability of the fraction,
drawn from a hash of its id, so the mix is the same on any cluster and no source is gathered anywhere.

Sources are compared in normal form. Documents of sources without a target, or without a source, add to the total
but aren't given out, nor are documents without tokens. A source without tokens has rate 0; a target with a null share has none. If several targets
name one source their shares are added and the smallest number of uses holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.columns import hash_fraction, normal
from veilspark.functions.materialize import cut, semi_by_size
from veilspark.llm.tokens import VOCABULARY, token_counts


def mix(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, fraction: float = 0.5, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, tokens, copies) with copies of at least 1, and the report per target (source,
    target_share, max_repeats, available_tokens, needed_tokens, rate, copies, tokens, actual_share, short)."""
    counts = cut(token_counts(df, text_col, [id_col, source_col], vocabulary).select(F.col(id_col).alias("id"), normal(source_col).alias("source"), "tokens"))
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    wanted = targets.select(normal("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    needed = F.coalesce("target_share", F.lit(0.0)) * F.lit(float(fraction * total))
    plan = wanted.join(have, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0))).withColumn("needed_tokens", needed)
    limit = F.coalesce("max_repeats", F.lit(1)).cast("double")
    plan = plan.withColumn("rate", F.when(F.col("available_tokens") > 0, F.least(limit, F.col("needed_tokens") / F.col("available_tokens"))).otherwise(0.0)).withColumn("short", F.col("available_tokens") * limit < F.col("needed_tokens"))
    plan = cut(plan)
    draw = hash_fraction("id", seed=seed)
    copies = F.floor("rate").cast("int") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    mixed = semi_by_size(counts.where("tokens > 0"), plan.select("source", "rate"), ["source"], plan.count()).withColumn("copies", copies).where("copies > 0").select("id", "source", "tokens", "copies")
    used = mixed.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    report = plan.join(used, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "needed_tokens", "rate", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "short")
    everything = report.agg(F.sum("tokens").alias("_all"))
    return mixed, report.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")


def emitted(df: DataFrame, mixed: DataFrame, id_col: str) -> DataFrame:
    """The mix written out: every row of ``df`` as often as its copies, with the copy's number in ``copy``."""
    times = mixed.select(F.col("id").alias(id_col), "copies")
    return df.join(times, id_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
