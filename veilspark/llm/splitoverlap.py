"""Records of evaluation splits that also stand, exactly or almost, in the training split.

An exact prefix-filter join. All shingles are put in one order: first those that stand on one side only, then rare
ones before frequent ones. The order comes from one pass over all records that notes for each shingle's hash bucket
on which sides it occurs (2 x SIDE_BITS bits) and how often (2**COUNT_BITS counts); any fixed order is exact, and
where buckets are shared the order is only less sharp. Two sets of n and m shingles with a similarity of at least t
share a shingle among their first n - ceil(t n) + 1 and m - ceil(t m) + 1. Prefix entries whose shingle doesn't occur
on the other side are dropped in the task. The evaluation prefixes are the index, the training prefixes probe it,
with filters on length and on what the positions leave possible, then a bound from parity bitmaps; the survivors are
verified on whole sets.

Rows without id, text or a known split take no part; equal sets are one class on either side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import lists, map_arrow
from veilspark.functions.columns import normal
from veilspark.functions.hotjoin import blocked_join
from veilspark.functions.materialize import cut, stored
from veilspark.functions.shingles import U, set_keys, shingle_sets
from veilspark.functions.vectors import vector_total
from veilspark.llm.textclasses import similar_pairs, text_rows

#: Bits of the two fields of sides and of the count table; both are sent to every task (2 x 16 MB and 4 MB).
SIDE_BITS, COUNT_BITS = 27, 22
#: Words of 64 bits in the parity bitmap of a set.
PARITY_WORDS = 8
#: Classes a task remembers, so that copies it has met have no entries of their own.
MOST_SEEN = 1_000_000
#: Occurrences from which a shingle is counted among those that may be hot.
OFTEN = 255


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


class Order:
    """The order of shingles: of each hash bucket the sides it occurs on, and its number of occurrences."""

    def __init__(self, sides: list[np.ndarray], counts: np.ndarray, side_bits: int, count_bits: int):
        self.sides, self.counts, self.side_bits, self.count_bits = sides, counts, side_bits, count_bits

    def both(self, h: np.ndarray) -> np.ndarray:
        """Whether a shingle may occur on both sides."""
        at = (h >> U(64 - self.side_bits)).astype(np.int64)
        word, bit = at >> 5, (at & 31).astype(np.uint32)
        return ((self.sides[0][word] & self.sides[1][word]) >> bit) & np.uint32(1) == 1

    def often(self, h: np.ndarray) -> np.ndarray:
        return self._count(h) >= self._scale(np.array([OFTEN]))[0]

    def _count(self, h: np.ndarray) -> np.ndarray:
        return self.counts[(h & U((1 << self.count_bits) - 1)).astype(np.int64)]

    @staticmethod
    def _scale(n: np.ndarray) -> np.ndarray:
        """Counts on a logarithmic scale of one byte, eight steps for each doubling."""
        return np.minimum(np.round(7.9 * np.log2(1.0 + n)), 255).astype(np.uint8)

    def rank(self, h: np.ndarray) -> np.ndarray:
        return np.where(self.both(h), self._count(h), 0)


def order_of(rows: DataFrame, k: int, side_bits: int = SIDE_BITS, count_bits: int = COUNT_BITS) -> Order:
    """The order over all rows (text, held)."""
    half, chunk = 1 << (side_bits - 5), 1 << min(19, side_bits - 5)
    length = 2 * half + (1 << count_bits)

    def add(vector: np.ndarray, b: pa.RecordBatch) -> None:
        h, at = shingle_sets(b["text"].to_pylist(), k)
        held = np.repeat(b["held"].to_numpy(zero_copy_only=False), np.diff(at))
        for side in (0, 1):
            bit = (h[held == side] >> U(64 - side_bits)).astype(np.int64)
            np.bitwise_or.at(vector, side * half + (bit >> 5), np.uint32(1) << (bit & 31).astype(np.uint32))
        np.add.at(vector, 2 * half + (h & U((1 << count_bits) - 1)).astype(np.int64), np.uint32(1))

    total = vector_total(rows.select("text", "held"), length, "uint32", add, lambda c: "or" if c * chunk < 2 * half else "cap", chunks=-(-length // chunk))
    return Order([total[:half], total[half : 2 * half]], Order._scale(total[2 * half :].astype(np.float64)), side_bits, count_bits)


def _prefixes(texts: list, k: int, threshold: float, order: Order) -> tuple[np.ndarray, ...]:
    """Sets, their offsets, and of the prefix entries that may meet the other side: owner, hash, place."""
    h, at = shingle_sets(texts, k)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = order.rank(h)
    by = np.argsort(owner * 256 + rank, kind="stable")  # ties stay in order of the hash: sets are sorted by it
    place = np.arange(len(h)) - np.repeat(at[:-1], sizes)
    keep = (place < np.repeat(prefix_length(sizes, threshold), sizes)) & (rank[by] > 0)
    return h, at, owner[keep], h[by][keep], place[keep]


def _parities(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITY_WORDS) longs; each bit is the parity of the shingles hashed to it, so two sets that differ in d
    shingles differ in at most d bits."""
    width = 64 * PARITY_WORDS
    bit = ((h >> U(20)) % U(width)).astype(np.int64)
    odd = (np.bincount(owner * width + bit, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, width), axis=1).view(np.int64)


def _differing(a: str, b: str) -> Column:
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY_WORDS)]
    return reduce(Column.__add__, bits)


#: Bit of an entry's place that tells that its shingle may be frequent.
_FLAG = 1 << 30


def _known(rows: DataFrame, k: int, threshold: float, shared) -> DataFrame:
    """(id, split, held, c1, c2, size, parity, entries, places) of the records that have a shingle.

    Only the first record of a class that a task meets has entries.
    """

    def start():
        seen: set = set()

        def work(b: pa.RecordBatch) -> dict:
            h, at, owner, entry, place = _prefixes(b["text"].to_pylist(), k, threshold, shared.value)
            sizes, (c1, c2) = np.diff(at), set_keys(h, at)
            new = np.ones(b.num_rows, bool)
            if len(seen) > MOST_SEEN:
                seen.clear()
            for i, key in enumerate(zip(b["held"].to_pylist(), c1.tolist(), c2.tolist())):
                new[i] = key not in seen
                seen.add(key)
            keep = new[owner]
            owner, entry, place = owner[keep], entry[keep], place[keep]
            place = place + np.where(shared.value.often(entry), _FLAG, 0)
            ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
            parity = _parities(h, np.repeat(np.arange(b.num_rows), sizes), b.num_rows)
            return {"id": b["id"], "split": b["split"], "held": b["held"], "c1": c1, "c2": c2, "size": sizes.astype(np.int32), "parity": lists(parity.ravel(), np.arange(b.num_rows + 1) * PARITY_WORDS), "entries": lists(entry.view(np.int64), ends), "places": lists(place.astype(np.int32), ends)}

        return work

    return map_arrow(rows, "id string, split string, held boolean, c1 long, c2 long, size int, parity array<long>, entries array<long>, places array<int>", start).where("size > 0")


def split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("validation", "test"), threshold: float = 0.8, k: int = 5, side_bits: int = SIDE_BITS, count_bits: int = COUNT_BITS) -> tuple[DataFrame, DataFrame]:
    """Members (id, split, held, c1, c2) and links (a1, a2, b1, b2, similarity): a is a training class, b a held-out one.

    A class with members on both sides is linked with itself at similarity 1. An empty table gives empty results.
    """
    rows = text_rows(df, id_col, text_col, split=normal(split_col)).where(F.col("split").isin(*train, *held_out)).withColumn("id", F.col("id").cast("string")).withColumn("held", F.col("split").isin(*held_out))
    shared = df.sparkSession.sparkContext.broadcast(order_of(rows, k, side_bits, count_bits))
    known = stored(_known(rows.select("id", "split", "held", "text"), k, threshold, shared))
    members = known.select("id", "split", "held", "c1", "c2").distinct()
    # An entry names its class by one of the two keys; should two classes share it, both are verified.
    each = known.where(F.size("entries") > 0).select("held", F.col("c1").alias("c"), "size", F.explode(F.arrays_zip("entries", "places")).alias("e"))
    place = F.col("e.places").bitwiseAND(F.lit(_FLAG - 1)).cast("long")
    entries = each.select("held", "c", F.col("e.entries").alias("shingle"), F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(place).alias("at"), (F.col("e.places") >= _FLAG).alias("often"))
    probe = entries.where("not held").select("shingle", F.col("c").alias("a1"), F.col("at").alias("x"))
    index = entries.where("held").select("shingle", F.col("c").alias("b1"), F.col("at").alias("y"))
    t = threshold
    n, m = F.shiftright("x", 32), F.shiftright("y", 32)
    p, q = F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("y").bitwiseAND(F.lit(0xFFFFFFFF))
    hot = entries.where("often")
    # Copies met in several tasks stand here several times; the pairs are made distinct below.
    pairs = blocked_join(probe, index, ["shingle"], ["a1"], counted=hot.where("not held"), spread_right=["b1"], counted_right=hot.where("held"))
    pairs = pairs.where((F.least(n, m) >= t * F.greatest(n, m) - 1e-9) & (1 + F.least(n - p - 1, m - q - 1) >= t / (1 + t) * (n + m) - 1e-9))
    ends = known.groupBy("held", "c1", "c2").agg(F.first("parity").alias("parity"))
    a, b = (ends.where(c).select(*[F.col(f"c{i}").alias(f"{x}{i}") for i in (1, 2)], F.col("parity").alias(f"{x}p")) for x, c in (("a", "not held"), ("b", "held")))
    pairs = pairs.groupBy("a1", "b1").agg(F.max(n + m).alias("both")).join(a, "a1").join(b, "b1")
    # Exact too: sets of together n + m shingles that differ in d bits share at most (n + m - d) / 2.
    pairs = pairs.where((F.col("both") - _differing("ap", "bp")) / 2 >= t / (1 + t) * F.col("both") - 1e-9)
    pairs = cut(pairs.where("a1 <> b1 or a2 <> b2").select("a1", "a2", "b1", "b2"))
    reps = known.groupBy("c1", "c2").agg(F.min("id").alias("id"))
    near = similar_pairs(pairs, reps, rows, k, t)
    same = known.groupBy("c1", "c2").agg(F.min("held").alias("low"), F.max("held").alias("high")).where("low <> high")
    same = same.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.lit(1.0).alias("similarity"))
    return members, cut(near.unionByName(same))


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (train_id, held_id, held_split, similarity) of different ids that the links stand for."""
    a = members.where("not held").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("id").alias("train_id"))
    b = members.where("held").select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("id").alias("held_id"), F.col("split").alias("held_split"))
    return blocked_join(links.join(a, ["a1", "a2"]), b, ["b1", "b2"], ["train_id"], spread_right=["held_id"]).where("train_id <> held_id").select("train_id", "held_id", "held_split", "similarity")


def overlapping_held_out(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, split, texts, copies): held-out records that stand in the training split, with the number of different
    training texts and of training records they match; pairs aren't expanded."""
    sizes = members.where("not held").groupBy(F.col("c1").alias("a1"), F.col("c2").alias("a2")).agg(F.count(F.lit(1)).alias("n"))
    hit = links.join(sizes, ["a1", "a2"]).groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("copies"))
    held = members.where("held").withColumnRenamed("c1", "b1").withColumnRenamed("c2", "b2")
    return held.join(hit, ["b1", "b2"]).select("id", "split", "texts", "copies")
