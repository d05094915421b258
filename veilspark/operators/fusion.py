"""Evidence of several detectors fused per document, and the route that follows. Map-only, native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators import detect, recognise
from veilspark.operators.detect import SPANS

# Which evidence is strong or potential, and how much agreement adds.
STRONG = ("EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "EMPLOYEE_ID", "USER_ID", "MEDICAL_LICENSE", "PASSPORT")
POTENTIAL = ("PERSON", "ADDRESS", "DATE_OF_BIRTH", "LOCATION", "DATE_TIME", "NRP", "URL")
BOOST, NEAR = 0.3, 200
ROUTES = ("local_pii", "low_cost_llm", "local_non_pii")


def near_dates(every: Column) -> Column:
    """A semi-join on a band of NEAR signs: dates stay only near a person or a place."""
    anchors = F.filter(every, lambda s: s["type"].isin("PERSON", "LOCATION"))
    near = lambda d: F.exists(anchors, lambda a: (F.abs(a["start"] - d["end"]) <= NEAR) | (F.abs(d["start"] - a["end"]) <= NEAR))
    return F.filter(every, lambda s: (s["type"] != "DATE_TIME") | near(s))


def _types(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["type"]))


def fuse(df: DataFrame, patterns: str, ner: str) -> DataFrame:
    """Adds entities (recogniser's first), per_type_conf, the category lists and flags. Types come in the order in
    which they first occur; a type that both detectors report gains BOOST, at most 1."""
    both = F.array_intersect(_types(F.col(patterns)), _types(F.col(ner)))
    df = df.withColumn("_both", both).withColumn("entities", near_dates(F.concat(F.col(ner), F.col(patterns))))
    score = lambda s: F.when(F.array_contains("_both", s["type"]), F.least(F.lit(1.0), s["confidence"] + BOOST)).otherwise(s["confidence"])
    types = _types(F.col("entities"))
    best = F.transform(types, lambda t: F.array_max(F.transform(F.filter("entities", lambda s: s["type"] == t), score)))
    df = df.withColumn("_types", types).withColumn("per_type_conf", F.map_from_arrays("_types", best))
    return df.withColumns(
        {
            "detected_categories": F.array_sort("_types"),
            "strong_pii_categories": F.filter("_types", lambda t: t.isin(*STRONG)),
            "potential_pii_categories": F.filter("_types", lambda t: t.isin(*POTENTIAL)),
        }
    ).withColumns({"detected_pii": F.size("strong_pii_categories") > 0, "detected_any_pii": (F.size("strong_pii_categories") > 0) | (F.size("potential_pii_categories") > 0)}).drop("_both", "_types")


def route(df: DataFrame) -> DataFrame:
    """Adds route, routing_reason and needs_llm_review."""
    maybe = F.size("potential_pii_categories") > 0
    return df.withColumns(
        {
            "route": F.when(F.col("detected_pii"), ROUTES[0]).when(maybe, ROUTES[1]).otherwise(ROUTES[2]),
            "routing_reason": F.when(F.col("detected_pii"), "strong_pii_detected").when(maybe, "potential_pii_evidence").otherwise("no_meaningful_signal"),
            "needs_llm_review": ~F.col("detected_pii") & maybe,
        }
    )


def sweep(df: DataFrame, text_col: str = "full_text", ner_col: str | None = None) -> DataFrame:
    """The first sweep over any table or stream of documents: patterns, what a recogniser found (``ner_col``), fusion
    and route. Without a recogniser's column only patterns count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ner = recognise.kept(F.col(ner_col), text) if ner_col else F.array().cast(SPANS)
    df = df.withColumns({"_patterns": detect.pattern_spans(text), "_ner": ner, "has_person_hint": detect.has_person_hint(text)})
    return route(fuse(df, "_patterns", "_ner")).drop("_patterns", "_ner")
