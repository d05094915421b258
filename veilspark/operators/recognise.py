"""Named-entity recognition behind a small interface, and the filters on what a recogniser reports.

A recogniser is any picklable callable: a function of no arguments that, once in each task, returns a function of
(texts, languages) giving a list of spans for each text. The default finds names after titles and labels, dates and
places after labels in English and German; other languages have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.operators.detect import SPANS

Recogniser = Callable[[], Callable[[list[str], list[str]], list[list[dict]]]]

# What is kept of a recogniser's report.
KEPT_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "EMPLOYEE_ID", "USER_ID", "MEDICAL_LICENSE", "PERSON", "ADDRESS", "DATE_OF_BIRTH", "LOCATION", "DATE_TIME", "URL", "NRP")
LEAST_SCORE, PERSON_TOKENS = 0.5, 2
TITLE_STARTS = ("univ.", "prof.", "univ.prof.")

_DEFAULT = (
    ("PERSON", 0.85, re.compile(r"(?:\b(?:Mr|Ms|Mrs|Dr|Herr|Herrn|Frau)\.?\s+|\b(?:Contact|Ansprechpartner|Employee|Mitarbeiter|From|Von|Protokoll|Minutes taken by):\s*)((?:[A-ZÄÖÜ][\w'-]+)\s+(?:(?:von|van|de|la|der|zu)\s+)*[A-ZÄÖÜ][\w'-]+)")),
    ("DATE_TIME", 0.6, re.compile(r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember)\s+\d{4})\b")),
    ("LOCATION", 0.75, re.compile(r"\b(?:Location|Ort|Standort|Site):\s*([A-ZÄÖÜ][\w-]+)")),
)


def lexicon_recogniser() -> Callable[[list[str], list[str]], list[list[dict]]]:
    def run(texts: list[str], languages: list[str]) -> list[list[dict]]:
        out = []
        for text, language in zip(texts, languages):
            known = text and (language or "en")[:2].lower() in ("en", "de")
            out.append([{"type": kind, "value": m.group(1), "confidence": score, "source": "lexicon", "start": m.start(1), "end": m.end(1)} for kind, score, p in _DEFAULT for m in p.finditer(text)] if known else [])
        return out

    return run


def recognise(df: DataFrame, id_col: str, text_col: str, language_col: str | None, recogniser: Recogniser = lexicon_recogniser) -> DataFrame:
    """(id, ner) of every row; a null language is "en" only if the table has no language column."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(language_col) if language_col else F.lit("en")).alias("language"))

    def start():
        engine = recogniser()

        def work(b: pa.RecordBatch) -> dict:
            return {"id": b["id"], "ner": engine(b["text"].to_pylist(), b["language"].to_pylist())}

        return work

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, ner {SPANS}", start)


def with_ner(df: DataFrame, text_col: str, language_col: str | None = None, name: str = "ner", recogniser: Recogniser = lexicon_recogniser) -> DataFrame:
    """``df`` with what the recogniser reports in a column of its own: one pass, no join, every row kept."""
    rows = df.drop(name).withColumns({"_text": F.coalesce(F.col(text_col), F.lit("")), "_language": F.col(language_col) if language_col else F.lit("en")})
    kept = [c for c in df.columns if c != name]

    def start():
        engine = recogniser()

        def work(b: pa.RecordBatch) -> dict:
            return {c: b[c] for c in kept} | {name: engine(b["_text"].to_pylist(), b["_language"].to_pylist())}

        return work

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], f"`{name}` {SPANS}"])
    return map_arrow(rows, schema, start)


# Shapes of codes that recognisers take for places or phones.
DEPARTMENT_CODE, QUARTER, CODE_BEFORE = r"(?U)^[A-Z]{2,6}-\d+$", "^Q[1-4]$", r"(?U)[A-Z]{2,6}-\s*$"


def false_location(value: Column) -> Column:
    """Values that recognisers take for places: addresses of mail, department codes, quarters, titles, two letters."""
    flat = F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", "")
    first = F.regexp_extract(flat, r"(?U)^([^\r\n]*)", 1)
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    titled = F.lit(False)
    for t in TITLE_STARTS:
        titled = titled | F.startswith(first, F.lit(t))
    return F.contains(flat, F.lit("@")) | bare.rlike(DEPARTMENT_CODE) | bare.rlike(QUARTER) | (F.length(F.replace(first, F.lit("."), F.lit(""))) <= 2) | titled


def kept(ner: Column, text: Column) -> Column:
    """What stays of a report: known types with a sure score; names of two tokens; no false places; no tails of codes."""
    ner = F.filter(ner, lambda s: (s["confidence"] >= LEAST_SCORE) & s["type"].isin(*KEPT_TYPES))
    ner = F.filter(ner, lambda s: (s["type"] != "PERSON") | (F.size(F.filter(F.split(s["value"], r"(?U)\s+"), lambda t: t != "")) >= PERSON_TOKENS))
    ner = F.filter(ner, lambda s: (s["type"] != "LOCATION") | ~false_location(s["value"]))
    head = lambda s: F.substring(text, F.greatest(s["start"] - 7, F.lit(1)), F.least(s["start"], F.lit(8)))
    ner = F.filter(ner, lambda s: (s["type"] != "PHONE_NUMBER") | ~head(s).rlike(CODE_BEFORE))
    return F.transform(ner, lambda s: s.withField("confidence", F.round(s["confidence"], 3)))
