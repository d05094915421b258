"""Token counts of texts under an existing byte-level BPE vocabulary, and exact totals of slices.

Texts are cut into pieces as the vocabulary's pattern does, by code point classes over a whole batch at once. A
piece is merged as a linked list of symbols with a priority queue of possible merges; the symbols that survive are
its tokens. Each distinct piece is merged once and counted with its frequency; counts are kept for the task.

Null and empty texts have 0 tokens. Nothing is trained; the vocabulary's path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import normal
from veilspark.functions.shingles import hash_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Contractions of the pattern, which are pieces of their own at an apostrophe that starts a piece.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def merged_length(piece: bytes, table: dict[bytes, int]) -> int:
    """Symbols left of a piece when no merge of two neighbours is in the table; lowest rank first, then leftmost."""
    n = len(piece)
    if n < 2 or piece in table:
        return min(n, 1)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, left = [True] * n, n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := table.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two was merged with another neighbour since
        alive[j] = False
        end[i], after[i], left = stop, after[j], left - 1
        if after[i] < n:
            before[after[i]] = i
            if (r := table.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := table.get(piece[h:stop])) is not None:
            heapq.heappush(queue, (r, h, stop))
    return left


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Joined texts, their code points, where pieces start, and the first sign of each text (n + 1 values).

    The sign that ends each text in the joined string is a piece of its own.
    """
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    kind = _classes()[cps]
    kind[text_at[1:] - 1] = END
    before = np.concatenate([np.array([END], np.int8), kind[:-1]])
    start = kind != before
    start[text_at[:-1]] = start[text_at[1:] - 1] = True
    # The last white space of a run that ends before a word is a piece, or goes with the word if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[cps[last] == 32] + 1] = False
    quotes = np.flatnonzero((cps == 39) & start)
    for i in quotes.tolist():
        for c in CONTRACTIONS:
            if joined.startswith(c, i):
                start[i + 1] = False
                if kind[i + len(c)] != END:
                    start[i + len(c)] = True
                break
    return joined, cps, np.flatnonzero(start), text_at


class Counter:
    """Counts tokens of batches of texts; each distinct piece is merged once while it is kept."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.table, self.most, self.known = ranks(path), most, {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        joined, cps, starts, text_at = piece_starts([t or "" for t in texts])
        ends = np.append(starts[1:], len(cps))
        if len(self.known) > self.most:
            self.known.clear()
        names, first, back = np.unique(hash_spans(cps, starts, ends), return_index=True, return_inverse=True)
        sizes = np.empty(len(names), np.int64)
        for n, (h, i) in enumerate(zip(names.tolist(), first.tolist())):
            k = self.known.get(h)
            if k is None:
                k = self.known[h] = merged_length(joined[starts[i] : ends[i]].encode("utf-8", "surrogatepass"), self.table)
            sizes[n] = k
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[back])])
        at = np.searchsorted(starts, text_at)
        closing = sizes[back][at[1:] - 1]  # the sign between two texts
        return sums[at[1:]] - sums[at[:-1]] - closing


def token_counts(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of every row with its number of ``tokens``."""
    kind = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "tokens long"])
    rows = df.select(*keep, F.col(text_col).alias("_text"))

    def start():
        counter = Counter(vocabulary)

        def work(b: pa.RecordBatch) -> dict:
            return {c: b[c] for c in keep} | {"tokens": counter.count(b["_text"].to_pylist())}

        return work

    return map_arrow(rows, kind, start)


def token_budget(df: DataFrame, id_col: str, text_col: str, by: list[str], vocabulary: str = VOCABULARY, every: bool = False) -> DataFrame:
    """Exact totals (by..., level, documents, tokens) of all combinations of the labels and of each shorter list.

    Labels are in normal form; level is the number of labels a line is summed over (a null label at level 0 is a
    null in the data). With ``every``, totals by each subset of the labels instead of each shorter list, and a column
    ``grouping`` with a bit for each label, the first one highest, that is 1 where it is summed over. Rows that repeat an id count once; rows without an id count each.
    """
    counts = token_counts(df, text_col, [id_col, *by], vocabulary)
    labels = [normal(c).alias(c) for c in by]
    named = counts.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct("tokens", *labels)).alias("r")).select("r.*")
    rows = named.unionByName(counts.where(F.col(id_col).isNull()).select("tokens", *labels))
    level = sum((F.grouping(c).cast("int") for c in by), F.lit(0))
    grouped, names = (rows.cube(*by), [F.grouping_id().cast("int").alias("grouping")]) if every else (rows.rollup(*by), [])
    return grouped.agg(level.alias("level"), *names, F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
