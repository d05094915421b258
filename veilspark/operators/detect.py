"""Pattern detectors with exact offsets, as native expressions without a UDF or a shuffle.

A span is {type, value, confidence, source, start, end}; start counts signs from 0. Offsets follow from the pieces
between matches, so one pass with two built-in functions finds any number of matches. Word boundaries, digits and
case follow Unicode. Null and blank texts have no spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<type:string,value:string,confidence:double,source:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"
PATTERN_CONFIDENCE, PATTERN_SOURCE = 0.9, "custom_regex"

# Patterns, limits, formats and word lists that results must agree with.
NATIONALITIES = (
    "German", "French", "Polish", "Austrian", "Swiss", "Dutch", "Italian", "Portuguese", "Danish", "Swedish",
    "deutsch", "französisch", "polnisch", "österreichisch", "schweizerisch", "niederländisch", "italienisch", "portugiesisch", "dänisch", "schwedisch",
)
PATTERNS = {
    "EMAIL_ADDRESS": r"(?iuU)\b[a-zA-Z0-9._%+\-äöüÄÖÜß]+@[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}\b",
    "IBAN_CODE": r"(?uU)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"(?uU)\b(?:\d[ -]*?){12,19}\b",
    "MEDICAL_LICENSE": r"(?iuU)\b(?:Approbation(?:snummer)?|Arztnummer|Heilpraktiker|Medical\s+ID|Medizinische\s+Lizenz)\b",
    "PASSPORT": r"(?uU)\bP\d{8}\b",
    "URL": r"(?iuU)\bhttps?://[^\s]+\b",
    "PHONE_NUMBER": r"(?uU)(?<!\d)(?:(?:\+\d{1,3}\s?)?(?:\(0\)\s?|\(\d{2,5}\)\s?|0)\d[\d\s\-]{3,12}\d|(?:\+1[\s.\-]?)?\d{3}[.\-]\d{3}[.\-]\d{4})(?:\s?(?:x|ext\.?)\s?\d{2,6})?(?!\d)",
    "NRP": r"(?iuU)\b(?:" + "|".join(NATIONALITIES) + r")\b",
}
IDENTIFIERS = {
    "email": r"(?uU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "url": r"(?uU)https?://[^\s]+",
    "ip_address": r"(?uU)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "iban": r"(?uU)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){10,30}\b",
}
PERSON_HINT = r"(?iuU)\b(?:Name|Vorname|Nachname|Mitarbeiter|Employee|Herr|Frau|Mr|Ms|Dr|Adresse|Address|Geburtsdatum|Geburtstag|geb\.|geboren|Unterschrift|Signature|Ausweis|Reisepass|Passport|Führerschein|Fahrerlaubnis|Personalnummer|Personal.?ID|Employee.?ID)\b"
PHONE_DIGITS = (7, 20)
DATE_FORMATS = ("yyyy-M-d", "yyyy.M.d", "yyyy/M/d", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy", "M-d-yyyy", "M/d/yyyy")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once; inside higher-order functions an expression would be evaluated for
    each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _span(kind: str, value: Column, start: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(PATTERN_CONFIDENCE).alias("confidence"), F.lit(PATTERN_SOURCE).alias("source"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"))


#: Signs that every match of a detector holds, in lower case; texts without them aren't searched.
MUST_HOLD = {"EMAIL_ADDRESS": ("@",), "URL": ("http",), "MEDICAL_LICENSE": ("approbation", "arztnummer", "heilpraktiker", "medical", "medizinische"), "NRP": tuple(n.lower() for n in NATIONALITIES)}


def _may_match(text: Column, kind: str) -> Column:
    """False only where no match is possible. The few letters that match Latin ones without their lower case being
    equal are written as these first."""
    low = F.lower(F.translate(text, "\u017f\u0130\u0131", "sii"))
    return let(low, lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in MUST_HOLD[kind]]))


def spans(text: Column | str, pattern: str, kind: str) -> Column:
    """All matches of a pattern that isn't empty, in order, as spans."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    empty = F.array().cast(SPANS)

    def placed(found: Column) -> Column:
        def every(between: Column) -> Column:
            # One running sum over the pieces between matches and the matches themselves.
            sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda x, v: F.struct(F.length(x).alias("x"), F.length(v).alias("v")))
            begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            step = lambda a, s: F.struct((a["at"] + s["x"] + s["v"]).alias("at"), F.array_append(a["starts"], a["at"] + s["x"]).alias("starts"))
            return let(F.aggregate(sizes, begin, step)["starts"], lambda starts: F.zip_with(found, starts, lambda v, at: _span(kind, v, at)))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), every)).otherwise(empty)

    may = _may_match(text, kind) if kind in MUST_HOLD and pattern == PATTERNS[kind] else text.rlike(r"(?U)\S")
    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def like_date(value: Column) -> Column:
    """The whole value is a date in one of DATE_FORMATS."""
    shaped = value.rlike(r"^\s*\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\s*$")
    return shaped & F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in DATE_FORMATS]).isNotNull()


def phone_spans(text: Column | str) -> Column:
    """Phone spans with a possible number of digits that aren't dates."""
    digits = lambda s: F.length(F.regexp_replace(s["value"], r"\D", ""))
    return F.filter(spans(text, PATTERNS["PHONE_NUMBER"], "PHONE_NUMBER"), lambda s: digits(s).between(*PHONE_DIGITS) & ~like_date(s["value"]))


def without_phones_in_ibans(every: Column) -> Column:
    """An anti-join on overlapping intervals inside each row."""
    free = lambda s, ibans: ~F.exists(ibans, lambda i: (s["start"] < i["end"]) & (s["end"] > i["start"]))
    return let(every, lambda e: let(F.filter(e, lambda s: s["type"] == "IBAN_CODE"), lambda ibans: F.filter(e, lambda s: (s["type"] != "PHONE_NUMBER") | free(s, ibans))))


def pattern_spans(text: Column | str) -> Column:
    """Spans of all detectors in their order, phones inside IBANs left out."""
    return without_phones_in_ibans(F.concat(*[phone_spans(text) if k == "PHONE_NUMBER" else spans(text, p, k) for k, p in PATTERNS.items()]))


def has_person_hint(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(PERSON_HINT), F.lit(False))


def explode_spans(df: DataFrame, id_col: str, every: Column) -> DataFrame:
    """(id, type, value, start, end), one row a span.

    The outer form keeps the optimizer from evaluating the spans once more in a filter before they are laid out.
    """
    return df.select(F.col(id_col), F.explode_outer(every).alias("s")).where("s is not null").select(id_col, "s.type", "s.value", "s.start", "s.end")


def unexpected_literals(text: Column | str, allowed: Column, pattern: str) -> Column:
    """Matches of a pattern that aren't among the allowed values."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: ~F.array_contains(allowed, m))


def missing_literals(text: Column | str, required: Column) -> Column:
    """Required values that the text doesn't hold."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(required, lambda v: ~F.contains(text, v))
