"""Rewriting of made-up documents by a language model, with the template's text where it fails.

A rewrite counts only if it keeps every value that the document must hold and brings no identifier of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.scalars import strip
from veilspark.operators import detect, planner, review

PROMPT = "Rewrite the document in plain prose. Keep every value exactly as it is and add no other names, numbers or addresses. Answer with the text only.\n\nDocument:\n{text}"
#: Shapes of values that a rewrite must not bring with it.
OWN = (detect.IDENTIFIERS["email"], detect.IDENTIFIERS["iban"], detect.IDENTIFIERS["ip_address"])


def offline_rewriter(prompt_text: str, model: str) -> dict:
    """A stand-in without a network: the document's own lines as sentences."""
    body = prompt_text.partition("Document:\n")[2]
    return {"content": " ".join(line.strip() for line in body.splitlines() if line.strip()), "prompt_tokens": len(prompt_text) // 4, "completion_tokens": len(body) // 4, "cost": 0.0}


def rewritten(df: DataFrame, id_col: str, text_col: str, required_col: str, flag_col: str, model: str, provider: review.Provider = offline_rewriter) -> DataFrame:
    """(id, text, asked, succeeded): flagged documents with a text in the model's words where these hold all of
    ``required_col`` and no other identifier; else, and for all others, the text they had.

    An empty list or null of required values asks for nothing; a null or blank text isn't sent.
    """
    text = F.col(text_col)
    asked = F.coalesce(F.col(flag_col), F.lit(False)) & F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(required_col), F.array().cast("array<string>")).alias("required"), asked.alias("asked"))
    head, tail = PROMPT.split("{text}")

    def start():
        call = review.with_retries(provider)

        def work(b: pa.RecordBatch) -> dict:
            made = [call(f"{head}{t}{tail}", model).get("content") or "" if a else "" for t, a in zip(b["text"].to_pylist(), b["asked"].to_pylist())]
            return {c: b[c] for c in ("id", "text", "required", "asked")} | {"made": made}

        return work

    kind = rows.schema["id"].dataType.simpleString()
    got = map_arrow(rows, f"id {kind}, text string, required array<string>, asked boolean, made string", start).withColumn("made", strip("made"))
    foreign = F.concat(*[F.filter(F.regexp_extract_all("made", F.lit(p), F.lit(0)), lambda v: ~F.contains(F.col("text"), v)) for p in OWN])
    good = F.col("asked") & (F.col("made") != "") & (F.size(detect.missing_literals("made", F.col("required"))) == 0) & (F.size(foreign) == 0)
    return got.select("id", F.when(good, F.col("made")).otherwise(F.col("text")).alias("text"), "asked", F.coalesce(good, F.lit(False)).alias("succeeded"))


def with_sources(df: DataFrame, rewritten_docs: DataFrame, id_col: str, scenario_col: str, variant_col: str, free_text: list[str], whole: list[str]) -> DataFrame:
    """``df`` with what says how each record was made: generator and prompt version."""
    done = rewritten_docs.select(F.col("id").alias(id_col), "asked", "succeeded")
    m = planner.generation_metadata(F.col(scenario_col), F.col(variant_col), F.coalesce("asked", F.lit(False)), F.col("succeeded"), free_text, whole)
    return df.join(done, id_col, "left").withColumn("_m", m).withColumns({"synthetic_generator": F.col("_m.generator"), "generation_prompt_version": F.col("_m.prompt_version")}).drop("_m", "asked", "succeeded")
