"""Languages of documents and of their segments, by hierarchical discrimination.

A first linear support vector machine tells the language family, then one-versus-one machines separate the
languages within it. Features of a word are the word itself and its letter trigrams, hashed; a sentence is the mean
of its words, so a machine reduces to one number per word and a sentence to a difference of prefix sums.

The machines are fitted on a bounded sample of labelled rows (TRAIN_DOCS documents a language, chosen by a hash
of the id, and TRAIN_SENTENCES sentences of each); since labels may be wrong, the fit is repeated on
the sentences that the first fit agrees with. Everything else covers all rows and whole texts.

Null, empty and wordless texts have no segment and no language. A text whose sentences are all shorter than
``least_words`` has segments but no language that counts. Ties go to the language that comes first in LANGUAGES.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import has_text, hash_fraction, normal
from veilspark.functions.shingles import hash_spans, word_spans

LANGUAGES = ("en", "de", "nl", "fr", "es")
FAMILIES = (("en", "de", "nl"), ("fr", "es"))
PAIRS = tuple((a, b) for family in FAMILIES for i, a in enumerate(family) for b in family[i + 1 :])
BITS, TRAIN_DOCS, TRAIN_SENTENCES, LEAST_WORDS, CONFIDENT = 15, 300, 2_500, 8, 0.77
#: Ends of sentences: closing marks before white space, blank lines, and lines that begin with a label. Addresses of
#: pages and mail are in no language and end a sentence too.
_END = re.compile(r"https?://\S+\s*|[\w.+-]+@[\w.-]+\s*|[.!?…]+[\"'“”»)\]*]*\s+|\n\s*\n|\n(?=[^\n:.]{1,32}:\s)|>\s*\n?")


def _word_features(word: str) -> np.ndarray:
    """Hashed features of a word; a word with a digit has none."""
    if any(map(str.isdigit, word)):
        return np.zeros(0, np.int64)
    edged = f"^{word}$"
    parts = [word, word, *(edged[i : i + 3] for i in range(len(edged) - 2))]
    return np.fromiter((xxhash.xxh3_64_intdigest(("w" if i < 2 else "t") + p, i if i < 2 else 2) & ((1 << BITS) - 1) for i, p in enumerate(parts)), np.int64, len(parts))


def _sentences(texts: list) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text, word hashes, word starts and ends; of each sentence the first word, the text it is in and its first sign."""
    joined, cps, starts, ends, offsets = word_spans(texts)
    bounds = np.fromiter((m.end() for m in _END.finditer(joined)), np.int64)
    lengths = np.fromiter((len(t.lower()) + 1 if t else 1 for t in texts), np.int64, len(texts))
    text_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    at = np.unique(np.concatenate([bounds, text_at[:-1]]))
    at = at[at < text_at[-1]]
    owner = np.searchsorted(text_at, at, "right") - 1
    return joined, hash_spans(cps, starts, ends), starts, ends, np.searchsorted(starts, at), owner, at - text_at[owner]


class Words:
    """Scores of words under all machines, each distinct word computed once in a task."""

    def __init__(self, weights: np.ndarray, most: int = 500_000):
        self.weights, self.most = weights, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.rows = np.zeros((1024, self.weights.shape[1]))

    def scores(self, joined: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        names, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        ids = np.empty(len(names), np.int64)
        for n, (h, i) in enumerate(zip(names.tolist(), first.tolist())):
            k = self.index.get(h)
            if k is None:
                k = self.index[h] = len(self.index)
                if k == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                features = _word_features(joined[starts[i] : ends[i]])
                self.rows[k] = self.weights[features].sum(0)
            ids[n] = k
        return self.rows[ids[back]]


def decide(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and confidence of each sentence from the machines' mean scores (family, then PAIRS)."""
    family = np.where(scores[:, 0] >= 0, 0, 1)
    votes = np.full((len(scores), len(LANGUAGES)), np.inf)
    for p, (a, b) in enumerate(PAIRS):
        i, j = LANGUAGES.index(a), LANGUAGES.index(b)
        votes[:, i] = np.minimum(votes[:, i], scores[:, 1 + p])
        votes[:, j] = np.minimum(votes[:, j], -scores[:, 1 + p])
    for f, members in enumerate(FAMILIES):
        for lang in members:
            votes[family != f, LANGUAGES.index(lang)] = -np.inf
    best = votes.argmax(1)
    margin = votes[np.arange(len(votes)), best]
    return best, 1 / (1 + np.exp(-2.5 * np.abs(scores[:, 0]))) / (1 + np.exp(-2.5 * margin))


def _fit_one(cols: np.ndarray, rows: np.ndarray, values: np.ndarray, n: int, y: np.ndarray, steps: int = 60, penalty: float = 1e-6) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by accelerated gradient steps."""
    w = np.zeros(1 << BITS)
    v, rate = w.copy(), 2.0
    for step in range(steps):
        margin = 1 - y * np.bincount(rows, values * v[cols], n)
        g = np.bincount(cols, values * (-y * np.maximum(margin, 0) / n)[rows], len(w)) + penalty * v
        new = v - rate * 10 * g
        v = new + step / (step + 3) * (new - w)
        w = new
    return w


def fit(texts: list[str], labels: list[str]) -> np.ndarray:
    """Weights (features, machines) from labelled texts, sentences capped at TRAIN_SENTENCES a language."""
    joined, hashes, starts, ends, first, owner, _ = _sentences(texts)
    last = np.append(first[1:], len(starts))
    cache: dict[int, np.ndarray] = {}
    left = dict.fromkeys(LANGUAGES, TRAIN_SENTENCES)
    cols, sizes, y = [], [], []
    for a, b, t in zip(first.tolist(), last.tolist(), owner.tolist()):
        if b - a < LEAST_WORDS or not left[labels[t]]:
            continue
        left[labels[t]] -= 1
        parts = []
        for i in range(a, b):
            h = int(hashes[i])
            if h not in cache:
                cache[h] = _word_features(joined[starts[i] : ends[i]])
            parts.append(cache[h])
        cols.append(np.concatenate(parts))
        sizes.append(b - a)
        y.append(LANGUAGES.index(labels[t]))
    weights = np.zeros((1 << BITS, 1 + len(PAIRS)))
    if not cols:
        return weights
    counts, y = np.fromiter(map(len, cols), np.int64), np.array(y)
    flat, rows = np.concatenate(cols), np.repeat(np.arange(len(cols)), counts)
    values = np.repeat(1 / np.array(sizes), counts)
    use = np.ones(len(y), bool)
    tasks = [([LANGUAGES.index(x) for x in FAMILIES[0]], [LANGUAGES.index(x) for x in FAMILIES[1]]), *[([LANGUAGES.index(a)], [LANGUAGES.index(b)]) for a, b in PAIRS]]
    for _ in range(2):
        for m, (pos, neg) in enumerate(tasks):
            take = use & np.isin(y, pos + neg)
            keep = take[rows]
            number = np.cumsum(take) - 1
            weights[:, m] = _fit_one(flat[keep], number[rows[keep]], values[keep], int(take.sum()), np.where(np.isin(y[take], pos), 1.0, -1.0)) if take.any() else 0
        scores = np.stack([np.bincount(rows, values * weights[flat, m], len(y)) for m in range(weights.shape[1])], 1)
        use = decide(scores)[0] == y
    return weights


def label_code(label: Column | str) -> Column:
    """The first two letters of a label in normal form, null where there is no label."""
    return F.substring(normal(label), 1, 2)


def labelled_sample(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(key, label, text): about twice TRAIN_DOCS rows of each language, those with the smallest keys.

    A share of the key space holds about that many, whatever the number of rows; a key that repeats counts once, so
    copies of one row never swell the sample.
    """
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("label") == lang) & (F.col("key") < (2.0 * TRAIN_DOCS + 20) / n))
    return rows.where(wanted).groupBy("key", "label").agg(F.min("text").alias("text"))


def train(df: DataFrame, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Fit on TRAIN_DOCS labelled rows of each language, chosen by a hash of the id."""
    rows = df.where(has_text(text_col)).select(hash_fraction(id_col, seed=11).alias("key"), label_code(label_col).alias("label"), F.col(text_col).alias("text")).where(F.col("label").isin(*LANGUAGES))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = sorted(labelled_sample(rows, counts).collect(), key=lambda r: (r["key"], r["text"]))
    kept, left = [], dict.fromkeys(LANGUAGES, TRAIN_DOCS)
    for r in sample:
        if left[r["label"]]:
            left[r["label"]] -= 1
            kept.append(r)
    return fit([r["text"] for r in kept], [r["label"] for r in kept])


SEGMENTS = "id long, start int, lang string, confidence double, words int, longest int, sentences int"


def segments(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray, least_words: int = LEAST_WORDS, confident: float = CONFIDENT) -> DataFrame:
    """Segments (id, segments array of {start, lang, confidence, words, longest, sentences}): runs of neighbouring
    sentences in one language.

    Sentences too short or too unlike any language to be told join the segment before them. ``longest`` is the
    greatest number of words of a sentence that was told with enough confidence, 0 where there is none.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def start():
        words = Words(shared.value)

        def work(b: pa.RecordBatch) -> dict:
            joined, hashes, starts, ends, first, owner, place = _sentences(b["text"].to_pylist())
            last = np.append(first[1:], len(starts))
            n = last - first
            keep = n > 0
            first, last, owner, place, n = first[keep], last[keep], owner[keep], place[keep], n[keep]
            sums = np.concatenate([np.zeros((1, shared.value.shape[1])), np.cumsum(words.scores(joined, hashes, starts, ends), 0)])
            lang, sure = decide((sums[last] - sums[first]) / n[:, None])
            told = (n >= least_words) & (sure >= confident)
            # Sentences that can't be told take the language of the last told one of their text, else of the next.
            out = []
            bounds = np.searchsorted(owner, np.arange(b.num_rows + 1)).tolist()
            for i, j in zip(bounds[:-1], bounds[1:]):
                if i == j:
                    out.append([])
                    continue
                some = np.flatnonzero(told[i:j])
                if not len(some):
                    k = i + int(np.argmax(n[i:j]))
                    out.append([{"start": int(place[i]), "lang": LANGUAGES[lang[k]], "confidence": float(sure[k]), "words": int(n[i:j].sum()), "longest": 0, "sentences": 0}])
                    continue
                ls = lang[i:j][some]
                cuts = [0, *(np.flatnonzero(ls[1:] != ls[:-1]) + 1).tolist()]
                row = []
                for c, s in enumerate(cuts):
                    e = cuts[c + 1] if c + 1 < len(cuts) else len(some)
                    lo = i + (int(some[s]) if c else 0)
                    hi = i + (int(some[e]) if c + 1 < len(cuts) else j - i)
                    mine = i + some[s:e]
                    row.append({"start": int(place[lo]), "lang": LANGUAGES[ls[s]], "confidence": float(np.average(sure[mine], weights=n[mine])), "words": int(n[lo:hi].sum()), "longest": int(n[mine].max()), "sentences": int(e - s)})
                out.append(row)
            return {"id": b["id"], "segments": out}

        return work

    rows = df.where(has_text(text_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, f"id {kind}, segments array<struct<start int, lang string, confidence double, words int, longest int, sentences int>>", start)


def document_languages(found: DataFrame) -> DataFrame:
    """(id, lang, words, confidence): one row per language that counts in a document, confidence weighted by words."""
    s = found.select("id", F.explode("segments").alias("s")).where("s.longest > 0").select("id", "s.*")
    return s.groupBy("id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))


def wrong_or_mixed(df: DataFrame, found: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows (id, lang) of documents with several languages or with a label that isn't their only one."""
    langs = F.array_distinct(F.transform(F.filter("segments", lambda s: s["longest"] > 0), lambda s: s["lang"]))
    one = found.select("id", langs.alias("langs")).where(F.size("langs") > 0)
    label = df.select(F.col(id_col).alias("id"), label_code(label_col).alias("label"))
    hit = one.join(label, "id").where((F.size("langs") > 1) | ~F.col("label").eqNullSafe(F.col("langs")[0]))
    return hit.select("id", F.explode("langs").alias("lang")).distinct()
