"""A linear scorer of documents: hashed words, one weight vector for the document and one for each label.

Fitted by logistic regression on at most FIT_ROWS labelled rows, chosen by a hash of the id; everything is scored.
A text without words has the score of the bias alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.columns import hash_fraction
from veilspark.functions.scalars import ENTITY_LABELS, norm_bool
from veilspark.functions.shingles import U, word_hashes

BITS, FIT_ROWS, STEPS = 15, 3_000, 50


def _features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and weights of the distinct words of each text, and the text each belongs to; weights have norm 1."""
    h, at = word_hashes(texts)
    size = 1 << BITS
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    both = np.unique(owner * size + (h & U(size - 1)).astype(np.int64))
    owner, cols = both // size, both % size
    return cols, 1 / np.sqrt(np.bincount(owner, minlength=len(texts)))[owner], owner


def _logits(weights: np.ndarray, texts: Sequence[str | None]) -> np.ndarray:
    cols, values, owner = _features(texts)
    out = np.tile(weights[-1], (len(texts), 1))
    for m in range(weights.shape[1]):
        out[:, m] += np.bincount(owner, values * weights[cols, m], len(texts))
    return out


def fit_weights(texts: Sequence[str | None], truth: np.ndarray, steps: int = STEPS, penalty: float = 1e-5) -> np.ndarray:
    """(features + 1, machines) from a matrix of booleans; the last row is the bias."""
    cols, values, owner = _features(texts)
    n, size = max(len(texts), 1), 1 << BITS
    weights = np.zeros((size + 1, truth.shape[1]))
    for m in range(truth.shape[1]):
        w, v = np.zeros(size + 1), np.zeros(size + 1)
        y = truth[:, m].astype(float)
        for step in range(steps):
            p = 1 / (1 + np.exp(-(np.bincount(owner, values * v[cols], len(texts)) + v[-1])))
            g = np.append(np.bincount(cols, values * (p - y)[owner], size), (p - y).sum()) / n + penalty * v
            new = v - 4.0 * g
            v, w = new + step / (step + 3) * (new - w), new
        weights[:, m] = w
    return weights


def fit(df: DataFrame, id_col: str, text_col: str, truth: Column) -> np.ndarray:
    """Weights for the document (first) and each of ENTITY_LABELS, absent label columns counting as never true."""
    labels = [norm_bool(f"{e}_yes_no") if f"{e}_yes_no" in df.columns else F.lit(False) for e in ENTITY_LABELS]
    rows = df.where(F.col(id_col).isNotNull()).select(hash_fraction(id_col, seed=3).alias("key"), F.col(text_col).alias("text"), F.array(truth, *labels).alias("y"))
    share = FIT_ROWS / max(rows.count(), 1)
    sample = rows.where(F.col("key") < share).groupBy("key").agg(F.min(F.struct("text", "y")).alias("r")).select("key", "r.*")
    got = sorted(sample.collect(), key=lambda r: r["key"])
    truth_rows = np.array([r["y"] for r in got], bool).reshape(len(got), len(ENTITY_LABELS) + 1)
    return fit_weights([r["text"] for r in got], truth_rows)


def linear_scorer(weights: np.ndarray) -> Callable[[], Callable[[list[str]], tuple[list[float], list[dict[str, float]]]]]:
    """A scorer for ``decide.score_masked``."""

    def start():
        def run(texts: list[str]) -> tuple[list[float], list[dict[str, float]]]:
            p = 1 / (1 + np.exp(-_logits(weights, texts)))
            return np.round(p[:, 0], 6).tolist(), [dict(zip(ENTITY_LABELS, row)) for row in p[:, 1:].tolist()]

        return run

    return start
