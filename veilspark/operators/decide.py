"""Final decisions of the strategies: zones of a score, masked scoring, and projections on one first sweep.

Scores that aren't numbers count as not scored: they become null, and a scored document with a null score is routed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrow import map_arrow
from veilspark.functions.scalars import ENTITY_LABELS, strip

ZONES = ("confident_non_pii", "routed_to_llm", "confident_pii")


@dataclass(frozen=True)
class Strategy:
    """A runner and the labels its rows carry."""

    name: str
    runner: str
    provider: str = ""
    model_family: str = ""
    model_name: str = ""
    prediction_source: str = ""


STRATEGIES = {
    s.name: s
    for s in (
        Strategy("rule_based", "rules", prediction_source="rules"),
        Strategy("rule_plus_llm", "llm", "offline", "stub", "stub", "rules+llm"),
        Strategy("rule_plus_score", "score", "local", "linear", "linear", "rules+score"),
        Strategy("hybrid", "hybrid", "local", "linear", "linear", "rules+score+llm"),
    )
}


@dataclass(frozen=True)
class Model:
    """A model that a strategy may use: of which kind, where it runs, and how its rows are labelled."""

    name: str
    kind: str  # "llm" or "scorer"
    provider: str
    model_name: str
    local: bool = True


MODELS = {m.name: m for m in (Model("stub", "llm", "offline", "stub"), Model("linear", "scorer", "local", "linear"))}
#: What each runner needs, and its final decision.
NEEDS = {"rules": (), "llm": ("llm",), "score": ("scorer",), "hybrid": ("scorer", "llm")}


def model(name: str, kind: str | None = None, known: dict[str, Model] = MODELS) -> Model:
    """A model by name in any case; an unknown one, or one of another kind, is an error that lists those known."""
    key = name.strip().lower()
    if key not in known or kind not in (None, known[key].kind):
        raise ValueError(f"unknown model {name!r}; known: {sorted(k for k, m in known.items() if kind in (None, m.kind))}")
    return known[key]


def registered(entries: dict[str, dict], models: dict[str, Model] = MODELS) -> dict[str, Strategy]:
    """Strategies from a table of settings {name: {"runner", "llm", "scorer"}}; a runner that isn't known, a model it
    needs that is missing, or one of the wrong kind is an error."""
    out = {}
    for name, entry in entries.items():
        runner = entry.get("runner")
        if runner not in NEEDS:
            raise ValueError(f"strategy {name!r} has the unknown runner {runner!r}; known: {sorted(NEEDS)}")
        used = [model(entry.get(kind) or "", kind, models) for kind in NEEDS[runner]]
        source = "+".join(["rules", *("score" if m.kind == "scorer" else "llm" for m in used)])
        last = used[-1] if used else None
        out[name.strip().lower()] = Strategy(name.strip().lower(), runner, last.provider if last else "", last.kind if last else "", last.model_name if last else "", source)
    return out


def strategies(names: list[str], known: dict[str, Strategy] = STRATEGIES) -> list[Strategy]:
    """Strategies by name in any case; unknown ones are an error that lists those known."""
    wanted = [n.strip().lower() for n in names]
    bad = [n for n in wanted if n not in known]
    if bad or not wanted:
        raise ValueError(f"unknown strategies {bad}; known: {sorted(known)}")
    return [known[n] for n in wanted]


def _flag(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def number(p: Column | str) -> Column:
    """A score, null where it isn't a number."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(~F.isnan(p), p)


def zone(p: Column | str, t_low: float | Column, t_high: float | Column, scored: Column | None = None) -> Column:
    """Zone of a score; both bounds belong to the routed zone. Rows that weren't scored have an empty zone."""
    p = number(p)
    t_low, t_high = (F.lit(t) if isinstance(t, float | int) else t for t in (t_low, t_high))
    z = F.when(p < t_low, ZONES[0]).when(p > t_high, ZONES[2]).otherwise(ZONES[1])
    return z if scored is None else F.when(_flag(scored), z).otherwise("")


def by_rules(detected: str = "detected_pii") -> Column:
    return _flag(detected)


def by_llm(detected: str = "detected_pii", llm: str = "llm_pii") -> Column:
    return _flag(detected) | _flag(llm)


def by_score(threshold: float, detected: str = "detected_pii", scored: str = "needs_bert_review", p: str = "pii_probability") -> Column:
    return _flag(detected) | (_flag(scored) & (F.coalesce(number(p), F.lit(0.0)) >= threshold))


def by_zones(detected: str = "detected_pii", scored: str = "needs_bert_review", zone_col: str = "routing_zone", routed: str = "routed_to_llm", llm: str = "llm_pii") -> Column:
    sure = _flag(F.col(zone_col) == ZONES[2])
    return _flag(detected) | (_flag(scored) & sure) | (_flag(scored) & _flag(routed) & _flag(llm))


Scorer = Callable[[], Callable[[list[str]], tuple[list[float], list[dict[str, float]]]]]


def hash_scorer() -> Callable[[list[str]], tuple[list[float], list[dict[str, float]]]]:
    """A stand-in without a model: a score that follows from the text alone."""
    import xxhash

    def run(texts: list[str]) -> tuple[list[float], list[dict[str, float]]]:
        p = [xxhash.xxh3_64_intdigest(t or "") % 10_000 / 10_000 for t in texts]
        return p, [{label: (x * (i + 3)) % 1.0 for i, label in enumerate(ENTITY_LABELS)} for x in p]

    return run


def score_masked(df: DataFrame, id_col: str, text_col: str, mask_col: str, scorer: Scorer = hash_scorer) -> DataFrame:
    """(id, pii_probability, scores) of the rows with a true mask; only these reach the scorer."""
    rows = df.where(_flag(mask_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def start():
        model = scorer()

        def work(b: pa.RecordBatch) -> dict:
            p, scores = model(b["text"].to_pylist())
            return {"id": b["id"], "pii_probability": p, "scores": [list(s.items()) for s in scores]}

        return work

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, pii_probability double, scores map<string,double>", start)


def predicted_labels(scores: Column | str, thresholds: dict[str, float] | None = None, default: float = 0.5) -> Column:
    """Rounded scores of the labels at or over their threshold."""
    limits = F.create_map(*[x for k, v in {label: default for label in ENTITY_LABELS}.items() for x in (F.lit(k), F.lit((thresholds or {}).get(k, v)))])
    scores = F.col(scores) if isinstance(scores, str) else scores
    return F.transform_values(F.map_filter(scores, lambda k, v: v >= F.coalesce(F.try_element_at(limits, k), F.lit(default))), lambda k, v: F.round(v, 4))


def scored_output(df: DataFrame, id_col: str, text_col: str, t_low: float, t_high: float, mask_col: str = "needs_llm_review", scorer: Scorer = hash_scorer) -> DataFrame:
    """Adds needs_bert_review, pii_probability, routing_zone and routed_to_llm; scored rows get the scorer's labels in
    per_type_conf. Rows that aren't scored keep what they had."""
    got = score_masked(df, id_col, text_col, mask_col, scorer).withColumnRenamed("id", id_col)
    out = df.drop("pii_probability").join(got, id_col, "left").withColumn("needs_bert_review", _flag(mask_col) & F.col("scores").isNotNull())
    if "per_type_conf" in df.columns:
        out = out.withColumn("per_type_conf", F.when(F.col("needs_bert_review"), predicted_labels("scores")).otherwise(F.col("per_type_conf")))
    out = out.withColumn("routing_zone", zone("pii_probability", t_low, t_high, F.col("needs_bert_review")))
    return out.withColumn("routed_to_llm", F.col("routing_zone") == ZONES[1]).withColumns({"t_low": F.lit(t_low), "t_high": F.lit(t_high)}).drop("scores")


def with_metadata(df: DataFrame, strategy: Strategy, run_id: str, prompt_version: str = "") -> DataFrame:
    """Constant columns that say where a prediction comes from, and predicted_pii of the final decision."""
    values = {"run_id": run_id, "strategy": strategy.name, "provider": strategy.provider, "model_family": strategy.model_family, "model_name": strategy.model_name, "prompt_version": prompt_version, "prediction_source": strategy.prediction_source}
    return df.withColumns({k: F.lit(v) for k, v in values.items()} | {"predicted_pii": _flag("final_pii")})


def run_strategy(df: DataFrame, strategy: Strategy, run_id: str, threshold: float = 0.5) -> DataFrame:
    """One strategy's decision over a swept and, where its runner needs it, scored and reviewed table."""
    rule = {"rules": by_rules, "llm": by_llm, "score": lambda: by_score(threshold), "hybrid": by_zones}[strategy.runner]
    return with_metadata(df.withColumn("final_pii", rule()), strategy, run_id)


def run_strategies(df: DataFrame, chosen: list[Strategy], run_id: str, threshold: float = 0.5) -> DataFrame:
    """All strategies' decisions over one swept, scored and reviewed table, as one row for each document and strategy."""
    rule = {"rules": by_rules, "llm": by_llm, "score": lambda: by_score(threshold), "hybrid": by_zones}
    parts = [
        F.struct(F.lit(s.name).alias("strategy"), F.lit(s.provider).alias("provider"), F.lit(s.model_family).alias("model_family"), F.lit(s.model_name).alias("model_name"), F.lit(s.prediction_source).alias("prediction_source"), rule[s.runner]().alias("final_pii"))
        for s in chosen
    ]
    gone = {"strategy", "provider", "model_family", "model_name", "prediction_source", "final_pii", "run_id", "predicted_pii"}
    rows = df.drop(*gone).withColumn("_s", F.explode(F.array(*parts)))
    return rows.select("*", "_s.*").drop("_s").withColumns({"run_id": F.lit(run_id), "predicted_pii": F.col("final_pii")})


#: The columns of a scored output, in their order.
CONTRACT = ("document_id", "contains_personal_data", "per_type_conf", "detected_pii", "detected_any_pii", "needs_llm_review", "needs_bert_review", "pii_probability", "routing_zone", "routed_to_llm", "t_low", "t_high", "predicted_pii")


def output_frame(df: DataFrame, routed_count: bool = True) -> DataFrame:
    """Exactly the columns of CONTRACT; absent ones are null. A routed document counts as predicted where no reviewer
    has decided yet."""
    predicted = _flag("detected_pii") | _flag(F.col("routing_zone") == ZONES[2]) | (_flag("routed_to_llm") if routed_count else F.lit(False))
    df = df.withColumn("predicted_pii", predicted)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in CONTRACT])


def dataset_version(df: DataFrame, column: str = "dataset_version", default: str = "unknown") -> str:
    """The one version a table holds; the default for none; several are an error."""
    if column not in df.columns:
        return default
    found = [r[0] for r in df.select(strip(column).alias("v")).where("v <> ''").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"several dataset versions: {sorted(found)}")
    return found[0] if found else default


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """The preferred columns that there are, then the others."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
