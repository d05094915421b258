"""Review by a language model: context windows, prompts, providers and the reading of their answers."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.scalars import strip

WINDOW, JOINER = 200, "\n\n---\n\n"
PROMPTS = {
    "v1": "Decide whether the document names or identifies a living person. Answer only with JSON of the form {{\"contains_pii\": true or false, \"reason\": \"...\"}}.\n\nDocument:\n{text}",
    "v2": "You are reviewing excerpts for data protection. State whether they hold personal data. Answer only with JSON of the form {{\"contains_pii\": true or false, \"reason\": \"...\"}}.\n\nExcerpts:\n{text}",
}
DELAYS = (0, 2, 5, 20)
Provider = Callable[[str, str], dict]


def windows(text: Column | str, spans: Column | str, window: int = WINDOW) -> Column:
    """Merged windows [{start, end}] around the spans that have offsets, cut at the text's ends, in order."""
    text, spans = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    size = F.length(text)
    cut = F.transform(F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull()), lambda s: F.struct(F.greatest(F.lit(0), s["start"] - window).alias("start"), F.least(size, s["end"] + window).alias("end")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (w["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(F.array_sort(cut), empty, step)


def review_text(text: Column | str, spans: Column | str, window: int = WINDOW) -> Column:
    """The text of all windows; the whole text where no span has offsets; empty for null and blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    merged = windows(text, spans, window)
    parts = F.transform(merged, lambda w: strip(F.substring(text, w["start"] + 1, w["end"] - w["start"])))
    return F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), "").when(F.coalesce(F.size(merged), F.lit(0)) > 0, F.array_join(parts, JOINER)).otherwise(text)


def prompt(text: Column, version: str) -> Column:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version!r}; known: {sorted(PROMPTS)}")
    head, tail = PROMPTS[version].replace("{{", "{").replace("}}", "}").split("{text}")
    return F.concat(F.lit(head), text, F.lit(tail))


def read_answer(answer: Column | str) -> Column:
    """{contains_pii, reason, success} of a model's answer.

    A missing value counts as false. If the whole isn't an object, the first block in braces is read. Text "true" is
    true; other text is not. Null, answers without a block and blocks that can't be read fail with a reason.
    """
    answer = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    fixed = F.regexp_replace(answer, r'"contains_pii"\s*:\s*,', '"contains_pii": false,')
    block = F.regexp_extract(fixed, r"(?s)\{.*?\}", 0)
    schema = "struct<contains_pii:string,reason:string>"
    whole = fixed.rlike(r"(?s)^\s*\{.*\}\s*$")
    read = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    valid = lambda c: F.try_parse_json(c).isNotNull()
    source = F.when(whole & valid(fixed), fixed).when((block != "") & valid(block), block)
    raw = F.lower(strip(read(source)["contains_pii"]))
    ok = source.isNotNull()
    failed = F.when(block == "", F.concat(F.lit("No JSON found in response: "), F.substring(answer, 1, 300))).otherwise(F.concat(F.lit("JSON parse error. Raw response: "), F.substring(answer, 1, 300)))
    number = raw.try_cast("double")
    yes = (raw == "true") | F.coalesce(number != 0, F.lit(False))
    return F.struct((ok & F.coalesce(yes, F.lit(False))).alias("contains_pii"), F.when(ok, F.coalesce(read(source)["reason"], F.lit(""))).otherwise(failed).alias("reason"), ok.alias("success"))


def offline_provider(prompt_text: str, model: str) -> dict:
    """A stand-in without a network: yes if the prompt's text holds an address of mail or a number of nine digits."""
    body = prompt_text.rpartition(":\n")[2]
    found = "@" in body or sum(map(str.isdigit, body)) >= 9
    return {"content": '{"contains_pii": %s, "reason": "offline"}' % str(found).lower(), "prompt_tokens": len(prompt_text) // 4, "completion_tokens": 8, "cost": 0.0}


def with_retries(provider: Provider, delays: tuple[float, ...] = DELAYS, wait: Callable[[float], None] = time.sleep) -> Provider:
    """Calls again after connection errors; other errors and the last attempt give an empty answer."""

    def call(text: str, model: str) -> dict:
        for delay in delays:
            wait(delay)
            try:
                return provider(text, model)
            except (ConnectionError, TimeoutError):
                continue
            except Exception as e:  # noqa: BLE001
                return {"content": "", "error": str(e)}
        return {"content": "", "error": "no connection"}

    return call


def run_reviews(df: DataFrame, id_col: str, text_col: str, spans_col: str, flag_col: str, model: str, version: str = "v1", provider: Provider = offline_provider) -> DataFrame:
    """(id, llm_pii, llm_reason, llm_request_success, llm_prompt_tokens, llm_completion_tokens, llm_total_tokens,
    llm_request_cost) of the flagged rows with a text. Only these reach the provider; the caller joins them back."""
    asked = df.where(F.coalesce(F.col(flag_col), F.lit(False))).select(F.col(id_col).alias("id"), review_text(text_col, spans_col).alias("t")).where("t <> ''").select("id", prompt(F.col("t"), version).alias("prompt"))

    def start():
        call = with_retries(provider)

        def work(b: pa.RecordBatch) -> dict:
            got = [call(p, model) for p in b["prompt"].to_pylist()]
            return {"id": b["id"], "content": [g.get("content", "") for g in got], "p": [g.get("prompt_tokens", 0) for g in got], "c": [g.get("completion_tokens", 0) for g in got], "cost": [float(g.get("cost") or 0.0) for g in got]}

        return work

    raw = map_arrow(asked, f"id {asked.schema['id'].dataType.simpleString()}, content string, p long, c long, cost double", start).withColumn("a", read_answer("content"))
    return raw.select("id", F.col("a.contains_pii").alias("llm_pii"), F.col("a.reason").alias("llm_reason"), F.col("a.success").alias("llm_request_success"), F.col("p").alias("llm_prompt_tokens"), F.col("c").alias("llm_completion_tokens"), (F.col("p") + F.col("c")).alias("llm_total_tokens"), F.col("cost").alias("llm_request_cost"))
