"""Near-duplicate records of one group: a MinHash LSH forest with exact verification.

Every record's set of word shingles gets a signature of ``trees`` times ``depth`` minimum hashes. A tree is a
trie over its own ``depth`` hashes; two records meet in it at depth d if their first d hashes are equal. The
search starts with the longest prefixes at which a pair of exactly the wanted similarity still meets in some tree
with probability ``floor``, drops candidates whose signatures can't belong to such a pair, verifies the others exactly, and estimates from the verified similarities how much
such prefixes miss (each found pair of similarity s stands for 1 / P(found | s, d) pairs). While the estimated
recall is under ``recall`` the prefixes are shortened by one level and the new candidates are verified.

Rows without id, group or text, or with fewer words than a shingle, are in no pair. Records that repeat an id
count once. Groups of equal texts are one class; classes are compared, members are attached afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow, rows_of
from veilspark.functions.hotjoin import blocked_join
from veilspark.functions.materialize import cut
from veilspark.functions.shingles import minhash, set_keys, shingle_sets
from veilspark.llm.textclasses import similar_pairs, text_rows

TREES, DEPTH, SEED = 16, 4, 20240917
#: Classes a task remembers, so that copies it has met carry no signature.
MOST_SEEN = 1_000_000
#: Standard deviations under the wanted similarity at which a candidate's estimate from the signature drops it.
SLACK = 4.5


def met(s: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """Probability that two sets of similarity s share a prefix of ``depth`` in at least one tree."""
    return 1.0 - (1.0 - s**depth) ** trees


def least_equal(s: float, size: int) -> int:
    """Equal two-bit minimum hashes of ``size`` that a pair of similarity s has, but for SLACK deviations."""
    p = s + (1 - s) / 4
    return int(np.floor(size * p - SLACK * np.sqrt(size * p * (1 - p))))


def _two_bits(sig: np.ndarray) -> list[np.ndarray]:
    """The lowest two bits of 64 minimum hashes as two long columns."""
    low = (sig & np.uint32(3)).astype(np.uint64)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return [np.bitwise_or.reduce(low[:, i : i + 32] << shifts[: low[:, i : i + 32].shape[1]], axis=1).view(np.int64) for i in (0, 32)]


def signatures(df: DataFrame, id_col: str, text_col: str, group_col: str, k: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(id, grp, s1, s2, k1, k2, sig): class keys, two bits of each minimum hash, and the signature of each record.

    Only the first record of a class that a task meets carries the signature, so copies never meet in a shuffle.
    """
    if trees * depth > 64:
        raise ValueError("a signature has at most 64 minimum hashes")

    def start():
        seen = set()

        def work(b: pa.RecordBatch) -> dict:
            h, at = shingle_sets(b["text"].to_pylist(), k)
            s1, s2 = set_keys(h, at)
            sig = minhash(h, at, trees * depth, SEED)
            k1, k2 = _two_bits(sig)
            new = np.ones(b.num_rows, bool)
            if len(seen) > MOST_SEEN:
                seen.clear()
            for i, key in enumerate(zip(b["grp"].to_pylist(), s1.tolist(), s2.tolist())):
                new[i] = key not in seen
                seen.add(key)
            return {"id": b["id"].cast(pa.string()), "grp": b["grp"], "s1": s1, "s2": s2, "k1": k1, "k2": k2, "some": np.diff(at) > 0, "sig": pc.if_else(pa.array(new), rows_of(sig), pa.scalar(None, pa.binary()))}

        return work

    rows = text_rows(df, id_col, text_col, grp=F.col(group_col).cast("string")).where(F.col("grp").isNotNull())
    return map_arrow(rows, "id string, grp string, s1 long, s2 long, k1 long, k2 long, some boolean, sig binary", start).where("some").drop("some")


def _bands(sigs: DataFrame, depth: int, trees: int, full: int) -> DataFrame:
    """(band, s1): for each tree the hash of the group and of the first ``depth`` minimum hashes.

    A row names its class by one of the two keys; should two classes share it, both are verified.
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("grp", t, F.substring(F.col("sig"), t * (4 * full) + 1, F.lit(4 * depth))))
    return sigs.where("sig is not null").select("s1", F.explode(bands).alias("band"))


def _unequal(a: str, b: str) -> Column:
    """Two-bit fields that differ between two longs."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, group_col: str, threshold: float = 0.8, k: int = 5, recall: float = 0.999, floor: float = 0.985, trees: int = TREES, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Members (id, grp, s1, s2) and links (a1, a2, b1, b2, similarity) between classes that meet in some group.

    An empty table gives two empty results.
    """
    sigs = cut(signatures(df, id_col, text_col, group_col, k, trees, depth))
    members = sigs.select("id", "grp", "s1", "s2").distinct()
    reps = sigs.groupBy(F.col("s1").alias("c1"), F.col("s2").alias("c2")).agg(F.min("id").alias("id"))
    bits = sigs.groupBy("s1", "s2").agg(F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    bits_a, bits_b = (bits.toDF(f"{x}1", f"{x}2", f"{x}k1", f"{x}k2") for x in "ab")
    texts = text_rows(df, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    ends = ["a1", "a2", "b1", "b2"]
    level = max((d for d in range(1, depth + 1) if met(threshold, d, trees) >= floor), default=1)
    links, seen = None, None
    while True:
        bands = _bands(sigs, level, trees, depth)
        # Most prefixes belong to one class: they are aggregated away, copies included, before any row is joined.
        spread = bands.groupBy("band").agg(F.min("s1").alias("low"), F.max("s1").alias("high"))
        rows = cut(bands.join(spread.where("low <> high").select("band"), "band").distinct())
        pairs = blocked_join(rows.select("band", F.col("s1").alias("a1")), rows.select("band", F.col("s1").alias("b1")), ["band"], ["a1"], spread_right=["b1"])
        pairs = pairs.where("a1 < b1").select("a1", "b1").distinct().join(bits_a, "a1").join(bits_b, "b1")
        pairs = pairs.where(F.lit(trees * depth) - _unequal("ak1", "bk1") - _unequal("ak2", "bk2") >= least_equal(threshold, trees * depth)).select(*ends)
        if seen is not None:
            pairs = pairs.join(seen, ends, "left_anti")
        pairs = cut(pairs)
        found = cut(similar_pairs(pairs, reps, texts, k, threshold))
        links = found if links is None else links.unionByName(found)
        seen = pairs if seen is None else seen.unionByName(pairs)
        if level == 1:
            return members, links
        s = F.col("similarity")
        got = links.agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (1 - F.pow(1 - F.pow(s, F.lit(level)), F.lit(trees)))).alias("all")).first()
        if not got["n"] or got["n"] / got["all"] >= recall:
            return members, links
        level -= 1


def member_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a, b, similarity) of different ids, a < b: links between classes and equal texts within one."""
    a = members.select("grp", F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("id").alias("x"))
    b = members.select("grp", F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("id").alias("y"))
    across = blocked_join(links.join(a, ["a1", "a2"]), b, ["grp", "b1", "b2"], ["x"], spread_right=["y"]).where("x <> y").select("x", "y", "similarity")
    copies = members.groupBy("grp", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", "s1", "s2")
    some = members.join(copies, ["grp", "s1", "s2"])
    within = blocked_join(some.withColumnRenamed("id", "x"), some.withColumnRenamed("id", "y"), ["grp", "s1", "s2"], ["x"], spread_right=["y"]).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("similarity").alias("similarity"))


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: its class of equal texts and the class's number of links to other texts.

    (document_id, grp, class_id, copies, links); copies and links of a class aren't expanded into pairs.
    """
    classes = members.select("grp", "s1", "s2").distinct()
    a, b = classes.toDF("grp", "a1", "a2"), classes.toDF("grp", "b1", "b2")
    there = links.join(a, ["a1", "a2"]).join(b, ["grp", "b1", "b2"])
    ends = there.select("grp", F.explode(F.array(F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")), F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")))).alias("c")).groupBy("grp", "c.s1", "c.s2").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("grp", "s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("class_id"))
    about = sizes.join(ends, ["grp", "s1", "s2"], "left")
    return members.join(about, ["grp", "s1", "s2"]).select(F.col("id").alias("document_id"), "grp", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
