"""Template residue, filler, error pages and script notices in records.

Labelled exemplars are retrieved through an inverted index of their words. A window of a text matches an exemplar
if it holds at least ``containment`` of the exemplar's TF-IDF weight. Of filler, whose words come in any order, there
are whole passages, and a window matches if the passage covers as much of the window's own weight; weights come from the document frequencies
of all records. Only windows around the exemplar's rarest words are looked at: the smallest set of words without
which the containment can't be reached, so nothing is missed. Exemplars of ordinary sentences that report about
errors, templates or notices are matched the same way. Both are cut to their first and last word that counts; a
residue match doesn't count if it lies wholly inside such a sentence and consists of words of that report's exemplar.

Null, empty and blank texts have no match. Of several matches the one with the greatest containment is given, ties
by the exemplar's place in the list; rows that repeat an id give one result each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.columns import has_text, normal
from veilspark.functions.shingles import word_hashes
from veilspark.functions.vectors import vector_total
from veilspark.llm.exemplars import FIELD, PASSAGES, REPORT, RESIDUE

CONTAINMENT, REPORT_CONTAINMENT = 0.8, 0.6
#: Words of a window that is compared with a passage.
PASSAGE_WINDOW = 5
#: Shapes of unfilled fields in lower case. Marks of scans and addresses in brackets are none.
_FIELDS = re.compile(
    r"\{\{[^{}]{0,60}\}\}"
    r"|\{%[^{}]{0,60}%\}"
    r"|\{(?!\s*(?:at|dot)\s*\})[\s_%-]*[^\W_][\w.%-]{0,40}[\s_%-]*\}"
    r"|\$\{[^{}]{1,60}\}"
    r"|\$[^\W\d]\w{2,40}\$"
    r"|%\([^()\s]{1,40}\)[a-z]"
    r"|<<[^<>]{1,60}>>"
    r"|<(?![^<>]*\s(?:at|dot)\s)[^\W\d_]+(?:[\s_-]+[^\W\d_]+)+>"
    r"|\[(?!\s*(?:at|dot|scan|seite|page|bild|image|stempel|stamp|unleserlich|illegible|unterschrift|signature)\b)[^\W\d_]+(?:['’]s)?(?::?[\s_]+[^\W\d_]+(?:['’]s)?)+\]"
    r"|__(?=[^\W_])[\w-]{2,40}__"
    r"|#[^\W\d]\w{2,40}#"
    r"|@@[^\W\d]\w{1,40}@@"
    r"|«[^\W\d_]+_\d+»"
    r"|(?<!\w)x{5,}(?!\w)"
)
_MARKS = re.compile(r"[{$%<\[_#@«]|xxxxx")


def _lower(text: str | None) -> str:
    text = (text or "").lower()
    return _FIELDS.sub(f" {FIELD} ", text) if _MARKS.search(text) else text


def exemplars() -> list[tuple[str, str, list[str]]]:
    """(kind, text, words) of all exemplars; kind "report" are those of ordinary sentences; passages come last."""
    every = [(kind, line.strip()) for kind, lines in [*RESIDUE.items(), ("report", REPORT), *PASSAGES.items()] for line in lines.strip().splitlines()]
    return [(kind, line, line.split()) for kind, line in every]


def _passages() -> int:
    return sum(len(lines.strip().splitlines()) for lines in PASSAGES.values())


def _terms() -> list[str]:
    return sorted({w for _, _, words in exemplars() for w in words})


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the exemplars' words, and the numbers of the words in that order."""
    h = word_hashes(["\n".join(_terms())])[0]
    order = np.argsort(h)
    return h[order], order


def _hits(texts: list, names: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words that are in the vocabulary: place, word number and text; and the words' offsets by text."""
    h, offsets = word_hashes([_lower(t) for t in texts])
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    place = np.flatnonzero(names[at] == h)
    return place, numbers[at[place]], np.searchsorted(offsets, place, "right") - 1, offsets


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the vocabulary, and the number of documents, over all rows (text)."""
    size = len(_terms())

    def add(vector: np.ndarray, b: pa.RecordBatch) -> None:
        names, numbers = _vocabulary()
        _, term, text, _ = _hits(b["text"].to_pylist(), names, numbers)
        vector += np.bincount(np.unique(text * (size + 1) + term) % (size + 1), minlength=size + 1).astype(np.int64)
        vector[size] += b.num_rows

    total = vector_total(rows.select("text"), size + 1, "int64", add, chunks=1)
    return total[:-1], int(total[-1])


class Index:
    """The exemplars' words, weights and anchors."""

    def __init__(self, df: np.ndarray, n: int):
        self.names, self.numbers = _vocabulary()
        number = {t: i for i, t in enumerate(_terms())}
        idf = np.log(1 + (n + 1) / (df + 1))
        self.entries, self.idf, self.unknown = [], idf, float(np.log(1 + (n + 1) / 2))
        every = exemplars()
        self.passages = range(len(every) - _passages(), len(every))
        for kind, _, words in every:
            terms, tf = np.unique([number[w] for w in words], return_counts=True)
            weight, limit = tf * idf[terms], REPORT_CONTAINMENT if kind == "report" else CONTAINMENT
            rare = np.argsort(-idf[terms], kind="stable")
            need = 1 + int(np.searchsorted(np.cumsum(weight[rare]), (1 - limit) * weight.sum() + 1e-9))
            width = len(words) + 4 + len(words) // 2 if len(words) > 1 else 1
            self.entries.append((kind, terms, tf, idf[terms], float(weight.sum()), terms[rare[:need]], width, limit))

    def _span(self, e: int, words: np.ndarray, start: int, end: int) -> tuple[int, int]:
        """The window without the words at its ends that the exemplar doesn't have, or has less often."""
        spare = Counter(words[start:end].tolist())
        spare.subtract(dict(zip(self.entries[e][1].tolist(), self.entries[e][2].tolist())))
        while start < end and spare[w := int(words[start])] > 0:
            spare[w] -= 1
            start += 1
        while start < end and spare[w := int(words[end - 1])] > 0:
            spare[w] -= 1
            end -= 1
        return start, end

    def _covered(self, e: int, place: np.ndarray, term: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """The windows of PASSAGE_WINDOW words whose weight the passage ``e`` covers, one for each place of its words."""
        mine = np.zeros(len(self.idf), bool)
        mine[self.entries[e][1]] = True
        at = place[mine[term]]
        owner = np.searchsorted(offsets, at, "right") - 1
        keep = at + PASSAGE_WINDOW <= offsets[owner + 1]
        at, owner = at[keep], owner[keep]
        if not len(at):
            return []
        window = words[at[:, None] + np.arange(PASSAGE_WINDOW)]
        weight = np.where(window >= 0, self.idf[window], self.unknown)
        share = (weight * ((window >= 0) & mine[window])).sum(1) / weight.sum(1)
        ok = share >= CONTAINMENT - 1e-9
        return [(owner[ok], np.full(ok.sum(), e), share[ok], at[ok], at[ok], at[ok] + PASSAGE_WINDOW)]

    def search(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matches of residue exemplars: text, exemplar, containment and the window's first word in the text."""
        place, term, text, offsets = _hits(texts, self.names, self.numbers)
        by = np.argsort(term, kind="stable")
        ends = np.searchsorted(term[by], np.arange(len(self.names) + 1))
        words = np.full(int(offsets[-1]) + 1, -1, np.int32)
        words[place] = term
        found, reports = [], []
        for e, (kind, terms, tf, idf, total, anchors, width, limit) in enumerate(self.entries):
            if e in self.passages:
                found += self._covered(e, place, term, words, offsets)
                continue
            near = np.sort(np.concatenate([by[ends[t] : ends[t + 1]] for t in anchors]))
            if not len(near):
                continue
            p, owner = place[near], text[near]
            grid = p[:, None] + np.arange(-width + 1, width)
            inside = (grid >= offsets[owner][:, None]) & (grid < offsets[owner + 1][:, None])
            window = np.where(inside, words[np.clip(grid, 0, len(words) - 1)], -1)
            got = np.zeros((len(p), width))
            for t, n, w in zip(terms, tf, idf):
                sums = np.concatenate([np.zeros((len(p), 1), np.int32), np.cumsum(window == t, 1, dtype=np.int32)], 1)
                got += np.minimum(sums[:, width:] - sums[:, :-width], n) * w
            best = got.argmax(1)
            share = got[np.arange(len(p)), best] / total
            ok = share >= limit - 1e-9
            start = p[ok] - width + 1 + best[ok]
            end = np.minimum(start + width, offsets[owner[ok] + 1])
            (reports if kind == "report" else found).append((owner[ok], np.full(ok.sum(), e), share[ok], np.maximum(start, offsets[owner[ok]]), p[ok], end))
        empty = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) + (np.zeros(0, np.int64),) * 3]
        owner, e, share, start, _, end = map(np.concatenate, zip(*(found or empty)))
        keep = np.ones(len(owner), bool)
        told: dict[int, list[tuple[int, int, int]]] = {}
        for _, t, k, i, j in sorted((-x, t, k, *self._span(k, words, i, j)) for t, k, x, i, _, j in {h for hits in reports for h in zip(*(c.tolist() for c in hits))}):
            # Of overlapping windows of one exemplar the best one is the sentence.
            if not any(k == other and i < high and low < j for other, low, high in told.get(t, [])):
                told.setdefault(t, []).append((k, i, j))
        for h in np.flatnonzero(np.isin(owner, list(told))).tolist():
            i, j = self._span(int(e[h]), words, int(start[h]), int(end[h]))
            mine = set(words[i:j].tolist()) & set(self.entries[e[h]][1].tolist())
            keep[h] = not any(low <= i and j <= high and mine <= set(self.entries[k][1].tolist()) for k, low, high in told[int(owner[h])])
        return owner[keep], e[keep], share[keep], start[keep] - offsets[owner[keep]]


def residue(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, kind, exemplar, containment, word) of every row with an id; kind is null where there is no match."""
    rows = df.where(has_text(text_col)).select(F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(frequencies(rows))
    kinds = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", *[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "kind string, exemplar string, containment double, word int"])

    def start():
        index, every = Index(*shared.value), exemplars()

        def work(b: pa.RecordBatch) -> dict:
            owner, e, share, at = index.search(b["text"].to_pylist())
            kind, name, best, word = ([None] * b.num_rows for _ in range(4))
            for i in np.lexsort((-e, share)).tolist():
                o = int(owner[i])
                kind[o], name[o], best[o], word[o] = every[e[i]][0], every[e[i]][1], float(share[i]), int(at[i])
            return {c: b[c] for c in ("id", *keep)} | {"kind": kind, "exemplar": name, "containment": best, "word": word}

        return work

    return map_arrow(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")), kinds, start)


def exclude_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose record has no match in any of its rows; rows without an id are checked by themselves."""
    hit = residue(df, id_col, text_col).where("kind is not null").select(F.col("id").alias(id_col)).distinct()
    return df.join(hit, id_col, "left_anti")


def residue_report(df: DataFrame, id_col: str, text_col: str, by: str) -> DataFrame:
    """Per label in normal form: records, excluded records and their share, and the excluded ones by kind."""
    found = residue(df, id_col, text_col, (by,)).select("id", normal(by).alias(by), "kind")
    one = found.groupBy("id").agg(F.min(by).alias(by), F.max("kind").alias("kind"))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in RESIDUE]
    return one.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.count("kind").alias("excluded"), *kinds).withColumn("share", F.col("excluded") / F.col("records"))
