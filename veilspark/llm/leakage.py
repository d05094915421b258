"""Held-out passages in a corpus, by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the TF-IDF weights.
2. A randomised SVD of TF-IDF passages: every task adds its part of (A'A) G for a random matrix G in one pass; the
   driver gets a matrix of fixed size and takes the leading directions from it (Nystroem). The directions are
   fitted on at most FIT_DOCS documents chosen by a hash; every passage of every document is indexed with them.
3. A passage is a window of WINDOW words; those of a document start at every STRIDE-th word, those of an item at
   every word, so a common run of WINDOW + STRIDE - 1 words or more always holds two equal passages.
4. Candidates are all pairs with a cosine of at least ``cosine`` that pass the answer check, which asks the document's
   passage for ANSWER of the RAREST rarest words of the item's passage. Both conditions are exact, so the search may
   begin with either: passages are looked up by the pairs of rare words that they hold, then the cosine is compared. A pair's cosine depends on its own words only, so it is
   the same in every block.
5. Each candidate is checked on the words themselves: the run of equal words it lies in is followed to both sides.
   The longest common subsequence of the surroundings is measured for every candidate of a document and item without
   a run of ``least_run`` words, but for those whose words in common can't reach ``least_share``.

Items are handled in blocks of BLOCK passages, one pass over the corpus for each block, so what is sent to the
tasks has a fixed size. Null, empty and shorter texts have no passage and no leak; repeated ids give one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import has_text, hash_fraction
from veilspark.functions.materialize import cut
from veilspark.functions.shingles import U, mix, word_hashes
from veilspark.functions.vectors import vector_total

FEATURE_BITS, RANK, OVERSAMPLE, FIT_DOCS = 15, 48, 8, 20_000
WINDOW, STRIDE, RAREST, ANSWER, BLOCK, SEED = 16, 8, 3, 2, 200_000, 5
#: Pairs looked at together, which bounds the memory of a batch.
_PAIRS = 1_000_000
_MASK = U((1 << FEATURE_BITS) - 1)


def _features(h: np.ndarray) -> np.ndarray:
    return (h & _MASK).astype(np.int64)


def document_weights(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of each feature over all rows (text), and their number."""
    size = 1 << FEATURE_BITS

    def add(vector: np.ndarray, b: pa.RecordBatch) -> None:
        h, at = word_hashes(b["text"].to_pylist())
        owner = np.repeat(np.arange(b.num_rows), np.diff(at))
        vector[:size] += np.bincount(np.unique(owner * size + _features(h)) & (size - 1), minlength=size)
        vector[size] += b.num_rows

    total = vector_total(rows, size + 1, "int64", add, chunks=4)
    n = int(total[size])
    return np.log((n + 1) / (total[:size] + 1) + 1).astype(np.float32), n


def fit_sample(rows: DataFrame, n: int) -> DataFrame:
    """About FIT_DOCS different texts of ``n`` rows, chosen by a hash of the text; all where there are fewer."""
    share = FIT_DOCS / max(n, 1)
    return rows.where(hash_fraction("text", seed=SEED) < share).dropDuplicates(["text"]) if share < 1 else rows


def directions(rows: DataFrame, idf: np.ndarray, n: int) -> np.ndarray:
    """Leading right singular directions of the TF-IDF passages, scaled; (features, RANK)."""
    width, size = RANK + OVERSAMPLE, 1 << FEATURE_BITS
    g = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0].astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((g, idf))
    sample = fit_sample(rows, n)

    def add(vector: np.ndarray, b: pa.RecordBatch) -> None:
        g, idf = shared.value
        h, at = word_hashes(b["text"].to_pylist())
        f = _features(h)
        whole = len(f) // WINDOW * WINDOW  # passages here may cross a text's end: the fit only needs typical ones
        if not whole:
            return
        f = f[:whole].reshape(-1, WINDOW)
        w = idf[f]
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        y = np.einsum("pw,pwk->pk", w, g[f], optimize=True)
        back = (w[:, :, None] * y[:, None, :]).reshape(-1, width)
        order = np.argsort(f.ravel(), kind="stable")
        names, first = np.unique(f.ravel()[order], return_index=True)
        vector.reshape(size, width)[names] += np.add.reduceat(back[order], first, axis=0)

    z = vector_total(sample.repartition(4), size * width, "float32", add).reshape(size, width).astype(np.float64)
    middle = g.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    keep = values > max(values.max(), 0) * 1e-9
    if not keep.any():
        return np.zeros((size, RANK), np.float32)
    u, s, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    out = np.zeros((size, RANK), np.float32)
    r = min(RANK, len(s))
    out[:, :r] = u[:, :r] / np.sqrt(np.maximum(s[:r], 1e-9))
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    """One of 64 bits for each word."""
    return U(1) << (words >> U(58))


def _names(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the passage of WINDOW words at each start."""
    out = np.zeros(len(starts), U)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out = (out ^ (out >> U(31))) * U(0xD1342543DE82EF95) + words[starts + k]
    return mix(out)


_SOME_BITS = 22


def _spread(code: np.ndarray) -> np.ndarray:
    """A place in a table of 2**_SOME_BITS for each pair code."""
    with np.errstate(over="ignore"):
        return ((code.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - _SOME_BITS)).astype(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


class Index:
    """The passages of the items of one block."""

    def __init__(self, items: list[tuple[object, str]], idf: np.ndarray, basis: np.ndarray):
        self.idf = idf
        self.table = (basis * idf[:, None]).astype(np.float32)
        self.ids = [i for i, _ in items]
        self.words, self.at = word_hashes([t for _, t in items])
        sums = self.sums(self.words)
        starts = np.concatenate([np.arange(a, b - WINDOW + 1) for a, b in zip(self.at[:-1], self.at[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
        vectors = (sums[starts + WINDOW] - sums[starts]).astype(np.float32)
        self.vectors = _unit(vectors)
        self.names = _names(self.words, starts)
        self.starts, self.owner = starts, np.searchsorted(self.at, starts, "right") - 1
        mine = self.words[starts[:, None] + np.arange(WINDOW)]
        self.rare = np.take_along_axis(mine, np.argsort(-idf[_features(mine)], axis=1, kind="stable")[:, :RAREST], 1)
        # Lookups: a passage stands under each pair of its rare words.
        self.keys = np.unique(self.rare)
        number = np.searchsorted(self.keys, self.rare)
        low, high = (np.stack([f(number[:, i], number[:, j]) for i, j in combinations(range(RAREST), ANSWER)], 1) for f in (np.minimum, np.maximum))
        codes = (low * len(self.keys) + high).ravel()
        by = np.argsort(codes, kind="stable")
        self.order = by // low.shape[1]
        self.pairs, at = np.unique(codes[by], return_index=True)
        self.ends = np.append(at, len(by))
        self.some = np.zeros(1 << _SOME_BITS, bool)
        self.some[_spread(self.pairs)] = True

    def sums(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((1, RANK)), np.cumsum(self.table[_features(words)], axis=0, dtype=np.float64)])

    def candidates(self, words: np.ndarray, at: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of the document's passage, item passage and cosine of all candidate pairs."""
        counts = np.maximum((np.diff(at) - WINDOW) // STRIDE + 1, 0)
        first = np.repeat(at[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        if not len(first) or not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        grid = np.arange(WINDOW)
        names = _names(words, first)
        key = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        key[self.keys[key] != words] = -1
        key = -np.sort(-key[first[:, None] + grid], axis=1)
        key[:, 1:][key[:, 1:] == key[:, :-1]] = -1
        passage = np.flatnonzero((key >= 0).any(1))  # each row: different rare words of the items, then -1
        key = -np.sort(-key[passage], axis=1)
        size = (key >= 0).sum(1)
        hits = []
        for j in range(WINDOW):
            rows = np.flatnonzero(size > j)
            if not len(rows):
                break
            for i in range(j + 1):  # a word that is rare twice in an item's passage is a pair of its own
                code = key[rows, j] * len(self.keys) + key[rows, i]
                may = np.flatnonzero(self.some[_spread(code)])
                at_pair = np.minimum(np.searchsorted(self.pairs, code[may]), len(self.pairs) - 1)
                real = self.pairs[at_pair] == code[may]
                hits.append((passage[rows[may[real]]], at_pair[real]))
        passage, pair = map(np.concatenate, zip(*hits)) if hits else (np.zeros(0, np.int64),) * 2
        by = np.argsort(passage, kind="stable")
        passage, pair = passage[by], pair[by]
        low, n = self.ends[pair], np.diff(self.ends)[pair]
        done = np.cumsum(n)
        # Cuts between passages, so that all hits of one are looked at together and each pair comes once.
        cuts = np.searchsorted(passage, passage[np.searchsorted(done, np.arange(0, int(done[-1]) if len(done) else 0, _PAIRS), "left")], "left") if len(done) else np.zeros(0, np.int64)
        cuts = np.unique(cuts).tolist() + [len(n)]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j in zip(cuts[:-1], cuts[1:]):
            size = n[i:j]
            p = np.repeat(passage[i:j], size)
            q = self.order[np.arange(len(p)) + np.repeat(low[i:j] - (np.cumsum(size) - size), size)]
            both = np.sort(p * len(self.starts) + q)
            p, q = np.divmod(both[np.append(True, both[1:] != both[:-1])] if len(both) else both, len(self.starts))
            some, back = np.unique(p, return_inverse=True)
            vectors = np.zeros((len(some), RANK), np.float32)
            for k in range(WINDOW):
                vectors += self.table[_features(words[first[some] + k])]
            vectors = _unit(vectors)
            near = np.concatenate([np.einsum("ij,ij->i", vectors[back[a : a + 100_000]], self.vectors[q[a : a + 100_000]]) for a in range(0, len(p), 100_000)] or [np.zeros(0)])
            near[names[p] == self.names[q]] = 1.0  # also where no word is in the fitted sample and the vector is zero
            keep = near >= cosine
            out.append((first[p[keep]], q[keep], near[keep]))
        return tuple(map(np.concatenate, zip(*out)))

    def runs(self, words: np.ndarray, at: np.ndarray, first: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the run of equal words that holds each candidate, 0 where the passages differ."""
        i = self.starts[q]
        same = np.ones(len(first), bool)
        for k in (0, WINDOW - 1, WINDOW // 2, *range(1, WINDOW - 1)):
            live = np.flatnonzero(same)
            same[live] = words[first[live] + k] == self.words[i[live] + k]
        out = np.zeros(len(first), np.int64)
        live = np.flatnonzero(same)
        if not len(live):
            return out
        text = np.searchsorted(at, first[live], "right") - 1
        item = self.owner[q[live]]
        length = np.full(len(live), WINDOW, np.int64)
        for step, d0, i0, dl, il in ((1, first[live] + WINDOW, i[live] + WINDOW, at[text + 1], self.at[item + 1]), (-1, first[live] - 1, i[live] - 1, at[text] - 1, self.at[item] - 1)):
            go, d, j = np.arange(len(live)), d0.copy(), i0.copy()
            while len(go):
                inside = (d[go] - dl[go]) * step < 0
                inside &= (j[go] - il[go]) * step < 0
                go = go[inside]
                go = go[words[d[go]] == self.words[j[go]]]
                length[go] += 1
                d[go] += step
                j[go] += step
        out[live] = length
        return out


def most_common(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """No less than the longest common subsequence of each range of ``a`` and its range of ``b``: the words of the one
    whose bit is set in a bitmap of 256 bits of the other."""
    if not len(a_from):
        return np.zeros(0, np.int64)
    maps = np.zeros((4, len(b_from)), U)
    for k in range(int((b_to - b_from).max())):
        w = b[np.minimum(b_from + k, len(b) - 1)]
        bit = np.where(b_from + k < b_to, _bits(w), U(0))
        for m in range(4):
            maps[m] |= np.where((w & U(3)) == m, bit, U(0))
    out, rows = np.zeros(len(a_from), np.int64), np.arange(len(a_from))
    for k in range(int((a_to - a_from).max())):
        w = a[np.minimum(a_from + k, len(a) - 1)]
        out += (a_from + k < a_to) & ((maps[(w & U(3)).astype(np.int64), rows] & _bits(w)) != 0)
    return out


def common_subsequences(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each range of words of ``a`` and its range of ``b``."""
    if not len(a_from):
        return np.zeros(0, np.int64)
    at = b_from[:, None] + np.arange(int((b_to - b_from).max()))
    theirs, inside = b[np.minimum(at, len(b) - 1)], at < b_to[:, None]
    row = np.zeros((len(at), at.shape[1] + 1), np.int16)
    for k in range(int((a_to - a_from).max())):
        x = a[np.minimum(a_from + k, len(a) - 1)]
        hit = row[:, :-1] + ((theirs == x[:, None]) & inside & (a_from + k < a_to)[:, None])
        row[:, 1:] = np.maximum.accumulate(np.maximum(hit, row[:, 1:]), axis=1)
    return row[:, -1].astype(np.int64)


def leaks(df: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, cosine: float = 0.9, least_run: int = WINDOW + STRIDE - 1, least_share: float = 0.7) -> DataFrame:
    """(id, item_id, longest_run, subsequence_share) of every document with a passage of an item.

    A pair is given if its longest run found has at least ``least_run`` words, or if the longest common subsequence
    of a candidate's surroundings covers ``least_share`` of the item's.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & has_text(text_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = items.where(F.col(item_id).isNotNull() & has_text(item_text)).groupBy(F.col(item_id).alias("item_id")).agg(F.min(item_text).alias("text"))
    idf, n = document_weights(rows.select("text"))
    basis = directions(rows.select("text"), idf, n)
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, item_id {held.schema['item_id'].dataType.simpleString()}, longest_run int, subsequence_share double"

    def search(block: list[tuple[object, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((block, idf, basis))

        def start():
            index = Index(*shared.value)

            def work(b: pa.RecordBatch) -> dict:
                ids = b["id"].to_pylist()
                words, at = word_hashes(b["text"].to_pylist())
                first, q, _ = index.candidates(words, at, cosine)
                run = index.runs(words, at, first, q)
                text, item = np.searchsorted(at, first, "right") - 1, index.owner[q]
                names, pair = np.unique(text * len(index.ids) + item, return_inverse=True)
                longest, share = np.zeros(len(names), np.int64), np.zeros(len(names))
                np.maximum.at(longest, pair, run)
                other = np.flatnonzero(longest[pair] < least_run)
                for k in range(0, len(other), 50_000):
                    o = other[k : k + 50_000]
                    t, m, i = text[o], item[o], index.starts[q[o]]
                    low, high = np.maximum(index.at[m], i - STRIDE), np.minimum(index.at[m + 1], i + WINDOW + STRIDE)
                    left, right = np.maximum(at[t], first[o] - 2 * STRIDE), np.minimum(at[t + 1], first[o] + WINDOW + 2 * STRIDE)
                    may = most_common(index.words, low, high, words, left, right) >= least_share * (high - low) - 1e-9
                    o, low, high, left, right = o[may], low[may], high[may], left[may], right[may]
                    np.maximum.at(share, pair[o], common_subsequences(index.words, low, high, words, left, right) / (high - low))
                share[longest >= least_run] = 1.0
                hit = np.flatnonzero((longest >= least_run) | (share >= least_share))
                return {"id": [ids[n] for n in (names[hit] // len(index.ids)).tolist()], "item_id": [index.ids[n] for n in (names[hit] % len(index.ids)).tolist()], "longest_run": longest[hit].tolist(), "subsequence_share": share[hit].tolist()}

            return work

        return map_arrow(rows, kinds, start)

    out, block, size = None, [], 0
    for r in held.orderBy("item_id").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= BLOCK:
            out = cut(search(block)) if out is None else out.unionByName(cut(search(block)))
            block, size = [], 0
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out.groupBy("id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("subsequence_share").alias("subsequence_share"))


def item_report(found: DataFrame, items: DataFrame, item_id: str, run: int = 24) -> DataFrame:
    """(item_id, documents, reworded): documents with a run of at least ``run`` words, and others with a likeness."""
    n = found.groupBy("item_id").agg(F.count_if(F.col("longest_run") >= run).alias("documents"), F.count_if(F.col("longest_run") < run).alias("reworded"))
    return items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id")).distinct().join(n, "item_id", "left").na.fill(0, ["documents", "reworded"])
