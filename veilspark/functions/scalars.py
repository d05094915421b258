"""Scalar expressions: coercions, guarded arithmetic, label inference, keys and templates.

All are built from native functions. Null input gives the result stated with each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("yes", "true", "1", "y", "ja", "pii")
ENTITY_LABELS = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "IBAN_CODE", "CREDIT_CARD", "PASSPORT", "NRP", "DATE_TIME", "IP_ADDRESS", "URL", "MEDICAL_LICENSE")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def norm_bool(x: Column | str) -> Column:
    """True for a true boolean or one of TRUE_WORDS in any case; null and everything else is False."""
    return F.coalesce(F.lower(strip(_c(x).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def is_yes(x: Column | str) -> Column:
    """True only for "yes" in any case."""
    return F.coalesce(F.lower(strip(_c(x).cast("string"))) == "yes", F.lit(False))


def is_blank(x: Column | str) -> Column:
    """Null, empty, white space or the word "nan"."""
    s = strip(_c(x).cast("string"))
    return s.isNull() | (s == "") | (F.lower(s) == "nan")


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, 0.0 where b is null, 0 or negative."""
    return F.when(_c(b) > 0, _c(a).cast("double") / _c(b)).otherwise(F.lit(0.0))


def safe_int(x: Column | str) -> Column:
    """Whole part of a number in text or of any number; null where there is none."""
    return _c(x).cast("string").try_cast("double").try_cast("int")


def safe_sum(df: DataFrame, name: str) -> Column:
    """Sum of what in the column is a number; 0.0 where the column is absent or empty."""
    return F.coalesce(F.sum(F.col(name).try_cast("double")), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def parse_scores(x: Column | str) -> Column:
    """Map of label to score from JSON or from the single-quoted form; an empty map where it can't be read."""
    return F.coalesce(F.from_json(_c(x), "map<string,double>"), F.create_map().cast("map<string,double>"))


def text_key(x: Column | str) -> Column:
    """Key that texts share if they differ in white space and case only; null counts as empty."""
    return F.md5(F.lower(strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))))


def token_estimate(x: Column | str) -> Column:
    """Rough number of word pieces of a text: one for 3.5 signs."""
    return F.length(F.coalesce(_c(x), F.lit(""))) / 3.5


def label_list(x: Column | str) -> Column:
    """Sorted, trimmed, non-empty parts of a list joined by semicolons; empty for null."""
    return F.array_sort(F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ";"), strip), lambda v: v != ""))


def safe_name(x: Column | str) -> Column:
    """Text as part of a file name."""
    return F.translate(_c(x), "/: ", "___")


def field_title(x: Column | str, language: Column | str | None = None, names: dict[str, str] | None = None) -> Column:
    """A field's name as a heading; in German, the given name where there is one."""
    plain = F.initcap(F.replace(_c(x), F.lit("_"), F.lit(" ")))
    if language is None or not names:
        return plain
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.when(_c(language) == "de", F.coalesce(F.try_element_at(known, _c(x)), plain)).otherwise(plain)


def active_labels(labels: Sequence[str] = ENTITY_LABELS) -> Column:
    """Labels whose ``<label>_yes_no`` column is set, in the given order."""
    return F.array_compact(F.array(*[F.when(norm_bool(f"{x}_yes_no"), F.lit(x)) for x in labels]))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(text.rlike("|".join(f"\\Q{w}\\E" for w in words)), F.lit(False))


def _cascade(text: Column, rules: Sequence[tuple[Sequence[str], str]], other: str) -> Column:
    out = None
    for words, value in rules:
        out = F.when(_holds(text, words), value) if out is None else out.when(_holds(text, words), value)
    return out.otherwise(other)


# The words and labels below must equal those of the data set's conventions.
GERMAN_TERMS = ("rechnung", "mitarbeiter", "personalnummer", "reisepass", "geburtsdatum", "adresse", "führerschein", "herr", "frau", "abteilung", "genehmigt")
SCENARIO_RULES = (
    (("expense", "reimbursement"), "expense_report"),
    (("invoice", "rechnung"), "invoice"),
    (("contract", "vertrag"), "contract"),
    (("employee", "mitarbeiter"), "employee_record"),
    (("passport", "reisepass"), "passport_record"),
    (("medical", "arzt"), "medical_record"),
    (("support", "ticket"), "customer_support"),
)
CHALLENGE_RULES = (
    (("invoice", "rechnung"), "invoice_number"),
    (("vat", "tax id", "steuer"), "vat_number"),
    (("employee", "personalnummer", "mitarbeiter"), "employee_id"),
    (("passport", "reisepass"), "passport_context"),
    (("medical", "arzt", "license"), "medical_context"),
    (("url", "http"), "url_or_web_identifier"),
    (("ip address", "ip_address"), "ip_address"),
)


def _lower(x: Column | str) -> Column:
    return F.lower(F.coalesce(_c(x).cast("string"), F.lit("")))


def infer_language(language: Column | str, text: Column | str) -> Column:
    """A blank language becomes "de" if the text holds a German term, else "en"; others stay."""
    return F.when(is_blank(language), F.when(_holds(_lower(text), GERMAN_TERMS), "de").otherwise("en")).otherwise(_c(language))


def infer_scenario(scenario: Column | str, kind: Column | str, name: Column | str, text: Column | str) -> Column:
    """A blank scenario is told by words of the document's type, file name and text; others stay."""
    return F.when(is_blank(scenario), _cascade(F.concat_ws(" ", _lower(kind), _lower(name), _lower(text)), SCENARIO_RULES, "general_document")).otherwise(_c(scenario))


def infer_challenge(category: Column | str, edge_case: Column | str, notes: Column | str, text: Column | str) -> Column:
    """A blank category is "none" unless the row is an edge case, then told by words; others stay."""
    told = _cascade(F.concat_ws(" ", _lower(notes), _lower(text)), CHALLENGE_RULES, "other_edge_case")
    return F.when(is_blank(category), F.when(norm_bool(edge_case), told).otherwise("none")).otherwise(_c(category))


def infer_primary(primary: Column | str, labels: Column) -> Column:
    """A blank primary type is NONE, the only label, or MULTIPLE; others stay."""
    n = F.size(labels)
    return F.when(is_blank(primary), F.when(n == 0, "NONE").when(n == 1, F.get(labels, F.lit(0))).otherwise("MULTIPLE")).otherwise(_c(primary))


def infer_count(count: Column | str, category_count: Column | str, labels: Column) -> Column:
    """A count of 0 or none becomes category_count if that is a number, else the number of labels."""
    have = F.coalesce(safe_int(count), F.lit(0))
    return F.when(have > 0, have).otherwise(F.coalesce(safe_int(category_count), F.size(labels)))


def seed_of(scenario: Column | str, row: Column | str | None = None, base: int = 42) -> Column:
    """Seed of a scenario by its number; with ``row``, of a row of it."""
    s = _c(scenario)
    return base + s * 1000 if row is None else s * 10_000 + _c(row)
