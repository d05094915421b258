"""Classes of records with equal shingle sets, and exact similarity of pairs of classes.

Shared by the near-duplicate and the split-overlap operators: both compare classes, not records, so any number
of copies of one text costs one signature and one comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import has_text
from veilspark.functions.hotjoin import blocked_join
from veilspark.functions.materialize import cut, semi_by_size
from veilspark.functions.shingles import jaccard, set_keys, shingle_sets


#: Links of a class that one task compares.
LINKS = 2_000


def text_rows(df: DataFrame, id_col: str, text_col: str, **labels: Column) -> DataFrame:
    """(id, text, *labels) of the rows that have an id and a text; other columns are left unread."""
    return df.where(F.col(id_col).isNotNull() & has_text(text_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in labels.items()])


def similar_pairs(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Exact check of candidate pairs of classes.

    pairs (a1, a2, b1, b2) name classes, reps (c1, c2, id) one record of each class, texts (id, text) holds the
    records; of several texts under one id, those whose set is the class's are taken. Returns the pairs with their
    similarity where it is at least ``threshold``. Only texts of classes in a pair are shuffled; the pairs of a class
    with many links are spread over several tasks.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")))).alias("c")).select("c.*").distinct()
    wanted = cut(reps.join(ends, ["c1", "c2"]).select("id", "c1", "c2"))
    held = semi_by_size(texts.select("id", "text"), wanted, ["id"], wanted.count())

    def start_keys():
        def work(b: pa.RecordBatch) -> dict:
            k1, k2 = set_keys(*shingle_sets(b["text"].to_pylist(), k))
            return {"c1": b["c1"], "c2": b["c2"], "text": b["text"], "fits": (k1 == b["c1"].to_numpy()) & (k2 == b["c2"].to_numpy())}

        return work

    held = map_arrow(held.select("c1", "c2", "text"), "c1 long, c2 long, text string, fits boolean", start_keys)
    held = held.where("fits").groupBy("c1", "c2").agg(F.first("text").alias("text"))
    both = blocked_join(pairs, held.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("text").alias("ta")), ["a1", "a2"], ["b1", "b2"], LINKS)
    both = blocked_join(both, held.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("text").alias("tb")), ["b1", "b2"], ["a1", "a2"], LINKS, counted=pairs)

    def start():
        def work(b: pa.RecordBatch) -> dict:
            first = {t: i for i, t in enumerate(dict.fromkeys(b["ta"].to_pylist() + b["tb"].to_pylist()))}
            h, at = shingle_sets(list(first), k)
            sets = [h[i:j] for i, j in zip(at[:-1], at[1:])]
            sims = np.fromiter((jaccard(sets[first[x]], sets[first[y]]) for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist())), float, b.num_rows)
            return {n: b[n] for n in ("a1", "a2", "b1", "b2")} | {"similarity": sims}

        return work

    return map_arrow(both.select("a1", "a2", "b1", "b2", "ta", "tb"), "a1 long, a2 long, b1 long, b2 long, similarity double", start).where(F.col("similarity") >= threshold)
