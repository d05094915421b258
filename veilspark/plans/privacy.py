"""Queries of the privacy-analytics operators over whole tables, with their SQL.

The tables hold no model scores of negatives and no live predictions. Where a query needs them it uses stand-ins that
both engines can compute: the score is a function of the text's length, the rules' decision is "the text has an @".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.functions.columns import normal
from veilspark.functions.materialize import cut, spread
from veilspark.operators import audit, decide, detect, errors, fusion, metrics, planner, recognise, review, scorer, splits, thresholds, upgrade
from veilspark.sources.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "synthetic_records")


def _missed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "false_negatives")


# Stand-ins, the same in both engines.
_P = "(length(coalesce(full_text, '')) * 7919 % 1000) / 1000.0"
_TRUE = "coalesce(lower(trim(CAST({} AS VARCHAR))) IN ('yes', 'true', '1', 'y', 'ja', 'pii'), false)"
_TRUTH = _TRUE.format("contains_personal_data")
_AT = "coalesce(contains(full_text, '@'), false)"


def _truth() -> Column:
    return S.norm_bool("contains_personal_data")



def _p() -> Column:
    return (F.length(F.coalesce("full_text", F.lit(""))) * 7919 % 1000) / 1000.0


def _at() -> Column:
    return F.coalesce(F.contains("full_text", F.lit("@")), F.lit(False))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).withColumns({"p": _p(), "detected_pii": _at(), "truth": _truth()}).withColumn("needs_llm_review", ~F.col("detected_pii") & F.col("p").between(0.3, 0.7)).withColumn("predicted_pii", F.col("detected_pii") | (F.col("p") > 0.7))


_SCORED = f"(SELECT *, NOT detected_pii AND p BETWEEN 0.3 AND 0.7 AS needs_llm_review, detected_pii OR p > 0.7 AS predicted_pii FROM (SELECT *, {_P} AS p, {_AT} AS detected_pii, {_TRUTH} AS truth FROM synthetic_records))"

# Detection ------------------------------------------------------------------------------------------------------


def _value_query(name: str, pattern: str, sql_pattern: str | None, kind: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return detect.explode_spans(_records(spark, folder), "document_id", detect.spans("full_text", pattern, kind)).groupBy("document_id", "value").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = name
    sql = f"SELECT document_id, value, count(*) AS n FROM (SELECT document_id, unnest(regexp_extract_all(full_text, '{sql_pattern}')) AS value FROM synthetic_records WHERE regexp_matches(full_text, '\\S')) GROUP BY ALL" if sql_pattern else None
    query(sql)(run)


for _name, _kind, _sql in (
    ("detect_email", "EMAIL_ADDRESS", r"(?i)\b[a-zA-Z0-9._%+\-äöüÄÖÜß]+@[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}\b"),
    ("detect_card", "CREDIT_CARD", r"\b(?:\d[ -]*?){12,19}\b"),
    ("detect_passport", "PASSPORT", r"\bP\d{8}\b"),
    ("detect_url", "URL", r"(?i)\bhttps?://[^\s]+\b"),
):
    _value_query(_name, detect.PATTERNS[_kind], _sql, _kind)
_value_query("detect_ip", detect.IDENTIFIERS["ip_address"], r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP_ADDRESS")


@query()
def detect_phone(spark, folder):
    return detect.explode_spans(_records(spark, folder), "document_id", detect.phone_spans("full_text"))


@query()
def detect_all_spans(spark, folder):
    """Spans of all detectors with offsets, phones inside IBANs suppressed."""
    return detect.explode_spans(spread(_records(spark, folder).select("document_id", "full_text")), "document_id", detect.pattern_spans("full_text"))


_HINT = detect.PERSON_HINT.removeprefix("(?iuU)")


@query(f"SELECT scenario_type, count(*) AS n, count(*) FILTER (coalesce(regexp_matches(full_text, '(?i){_HINT}'), false)) AS hinted FROM synthetic_records GROUP BY scenario_type")
def person_hints(spark, folder):
    return _records(spark, folder).groupBy("scenario_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(detect.has_person_hint("full_text")).alias("hinted"))


@query()
def sweep_routes(spark, folder):
    """How many documents the first sweep settles, per route, recogniser included: map-only up to the final count."""
    docs = recognise.with_ner(spread(_records(spark, folder).select("document_id", "full_text", "language")), "full_text", "language")
    return fusion.sweep(docs, ner_col="ner").groupBy("route", "routing_reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def sweep_with_recogniser(spark, folder):
    """The first sweep with the default recogniser of names, dates and places."""
    docs = _records(spark, folder).where("document_id is not null").select("document_id", "full_text", "language").dropDuplicates(["document_id"])
    swept = fusion.sweep(recognise.with_ner(docs, "full_text", "language"), ner_col="ner")
    return swept.select("document_id", "route", F.array_join("detected_categories", "|").alias("categories"), F.size("entities").alias("n_entities"))


@query(
    """WITH r AS (SELECT row_number() OVER () AS row, document_id, full_text, entities FROM false_negatives WHERE regexp_matches(full_text, '\\S')),
    s AS (SELECT row, document_id, greatest(0, e.start - 200) AS a, least(length(full_text), e."end" + 200) AS b FROM (SELECT row, document_id, full_text, unnest(entities) AS e FROM r)),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY row ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY row ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
    w AS (SELECT row, document_id, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
    d AS (SELECT row, document_id, count(*) AS n_windows, sum(b - a) AS signs FROM w GROUP BY ALL)
    SELECT document_id, n_windows, CAST(signs AS BIGINT) AS signs, count(*) AS n FROM d GROUP BY ALL"""
)
def context_windows(spark, folder):
    w = review.windows("full_text", "entities")
    df = _missed(spark, folder).where(F.col("full_text").rlike(r"\S")).select("document_id", w.alias("w")).where(F.size("w") > 0)
    return df.select("document_id", F.size("w").cast("long").alias("n_windows"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("signs")).groupBy("document_id", "n_windows", "signs").agg(F.count(F.lit(1)).alias("n"))


@query()
def reviews_offline(spark, folder):
    return review.run_reviews(_missed(spark, folder), "document_id", "full_text", "entities", "needs_llm_review", "offline").withColumnRenamed("id", "document_id")


# Decisions ------------------------------------------------------------------------------------------------------

_ZONE = "CASE WHEN p < 0.3 THEN 'confident_non_pii' WHEN p > 0.7 THEN 'confident_pii' ELSE 'routed_to_llm' END"


@query(f"SELECT {_ZONE} AS zone, count(*) AS n, count(*) FILTER (truth) AS positives FROM {_SCORED} GROUP BY ALL")
def zone_counts(spark, folder):
    return _scored(spark, folder).groupBy(decide.zone("p", 0.3, 0.7).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.count_if("truth").alias("positives"))


@query(
    """SELECT strategy, count(*) AS n, count(*) FILTER (coalesce(detected_pii, false)) AS by_rules,
    count(*) FILTER (coalesce(detected_pii, false) OR (coalesce(needs_bert_review, false) AND coalesce(pii_probability, 0) >= 0.2)) AS by_score,
    count(*) FILTER (coalesce(detected_pii, false) OR (coalesce(needs_bert_review, false) AND pii_probability > 0.25)) AS by_zones, count(*) FILTER (coalesce(detected_pii, false) OR coalesce(bert_pii, false)) AS by_llm FROM false_negatives GROUP BY strategy"""
)
def final_decisions(spark, folder):
    df = _missed(spark, folder).withColumn("z", decide.zone("pii_probability", 0.1, 0.25, F.col("pii_probability").isNotNull()))
    return df.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(decide.by_rules()).alias("by_rules"), F.count_if(decide.by_score(0.2)).alias("by_score"), F.count_if(decide.by_zones(zone_col="z", routed="bert_pii", llm="bert_pii")).alias("by_zones"), F.count_if(decide.by_llm(llm="bert_pii")).alias("by_llm"))


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    """One first sweep, one scoring of its open documents by a fitted linear scorer, one review, all strategies."""
    docs = _records(spark, folder).where("document_id is not null").dropDuplicates(["document_id"])
    swept = cut(fusion.sweep(recognise.with_ner(docs.select("document_id", "full_text", "contains_personal_data", "language"), "full_text", "language"), ner_col="ner").select("document_id", "full_text", "contains_personal_data", "detected_pii", "detected_any_pii", "needs_llm_review", "per_type_conf", "entities"))
    weights = scorer.fit(_records(spark, folder), "document_id", "full_text", _truth())
    scored = decide.scored_output(swept, "document_id", "full_text", 0.3, 0.7, scorer=scorer.linear_scorer(weights))
    reviewed = review.run_reviews(swept, "document_id", "full_text", "entities", "needs_llm_review", "stub").select(F.col("id").alias("document_id"), "llm_pii")
    return decide.run_strategies(scored.join(reviewed, "document_id", "left"), list(decide.STRATEGIES.values()), "run")


@query()
def strategy_outputs(spark, folder):
    """Metrics of all strategies."""
    return metrics.binary(_decided(spark, folder), _truth(), F.col("predicted_pii"), ("strategy",))


# Metrics --------------------------------------------------------------------------------------------------------

_SCORES = "round(coalesce((TP + TN) / nullif(n, 0), 0), 4) AS accuracy, round(coalesce(TP / nullif(TP + FP, 0), 0), 4) AS precision, round(coalesce(TP / nullif(TP + FN, 0), 0), 4) AS recall, round(coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0), 4) AS f1"
_COUNTS = "count(*) AS n, count(*) FILTER (truth AND pred) AS TP, count(*) FILTER (NOT truth AND NOT pred) AS TN, count(*) FILTER (NOT truth AND pred) AS FP, count(*) FILTER (truth AND NOT pred) AS FN"


_STAGES = " UNION ALL ".join(f"SELECT '{stage}' AS stage, {_TRUTH} AS truth, coalesce({c}, false) AS pred FROM false_negatives{w}" for stage, c, w in (("standardized", "predicted_pii", ""), ("sweep1_strong", "detected_pii", ""), ("sweep1_any", "detected_any_pii", ""), ("sweep2_llm", "bert_pii", " WHERE needs_llm_review"), ("final", "final_pii", "")))


@query(f"SELECT *, {_SCORES} FROM (SELECT stage, {_COUNTS} FROM ({_STAGES}) GROUP BY stage)")
def stage_metrics(spark, folder):
    """All five stages; the scorer's decision stands for the reviewer's, which the table doesn't hold."""
    return metrics.stage_metrics(_missed(spark, folder).withColumn("llm_pii", F.col("bert_pii")))


@query(
    f"""SELECT stage AS metric_name, 'document' AS metric_group, *  EXCLUDE (stage), {_SCORES} FROM (SELECT stage, {_COUNTS} FROM ({_STAGES}) GROUP BY stage)
    UNION ALL SELECT entity, 'entity', * EXCLUDE (entity), {_SCORES} FROM (SELECT entity, {_COUNTS.replace('pred)', 'hit)')} FROM (SELECT *, coalesce(list_contains(map_keys(per_type_conf), entity), false) AS hit FROM (@LABELS@)) GROUP BY entity)"""
)
def tidy_metrics(spark, folder):
    """Document stages and entities in one table."""
    df = _missed(spark, folder).withColumn("llm_pii", F.col("bert_pii"))
    return metrics.tidy(metrics.stage_metrics(df), metrics.entity_metrics(df, F.col("per_type_conf")))


_LABEL_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS entity, {_TRUE.format(f'{x}_yes_no')} AS truth, coalesce(contains(full_text, '{x[0]}'), false) AS pred, per_type_conf, {_TRUE.format(f'{x}_predicted')} AS flag FROM false_negatives" for x in S.ENTITY_LABELS)


@query(f"SELECT *, {_SCORES} FROM (SELECT entity, {_COUNTS.replace('pred)', 'hit)')} FROM (SELECT *, coalesce(list_contains(map_keys(per_type_conf), entity), false) AS hit FROM ({_LABEL_ROWS})) GROUP BY entity)")
def entity_metrics(spark, folder):
    return metrics.entity_metrics(_missed(spark, folder), F.col("per_type_conf"))


@query(f"SELECT entity, count(*) AS n, count(*) FILTER (truth) AS positives, count(*) FILTER (flag) AS predicted_n, count(*) FILTER (truth = flag) AS correct FROM ({_LABEL_ROWS}) GROUP BY entity")
def entity_slices(spark, folder):
    return errors.entity_slices(_missed(spark, folder))


@query("SELECT count(*) AS documents_total, count(*) FILTER (needs_llm_review) AS documents_sent_to_review, count(*) FILTER (NOT needs_llm_review) AS documents_resolved_locally, round(count(*) FILTER (needs_llm_review) / count(*), 4) AS routing_rate, round(count(*) FILTER (NOT needs_llm_review) / count(*), 4) AS local_processing_rate FROM " + _SCORED)
def routing_metrics(spark, folder):
    return metrics.routing(_scored(spark, folder))


# The table holds no counts of a reviewer's tokens; these follow from the text in both engines.
_TOKENS = {"llm_prompt_tokens": "length(coalesce(full_text, ''))", "llm_completion_tokens": "length(coalesce(full_text, '')) % 40 + 8", "llm_total_tokens": "length(coalesce(full_text, '')) + length(coalesce(full_text, '')) % 40 + 8", "llm_reasoning_tokens": "length(coalesce(full_text, '')) % 7", "llm_cached_tokens": "length(coalesce(full_text, '')) % 5"}
_USED = "(SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _TOKENS.items()) + ", CAST(length(coalesce(full_text, '')) % 100 AS DOUBLE) / 1e5 AS llm_request_cost, needs_llm_review AND length(coalesce(full_text, '')) % 9 > 0 AS llm_request_success FROM false_negatives)"
_USAGE = f"""SELECT run_id, strategy, count(*) FILTER (coalesce(needs_llm_review, false)) AS llm_requests_attempted, count(*) FILTER (coalesce(llm_request_success, false)) AS llm_requests_successful, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in _TOKENS)}, round(sum(llm_request_cost), 8) AS llm_reported_cost,
    count(*) FILTER (coalesce(needs_bert_review, false)) AS bert_requests_attempted, count(*) FILTER (coalesce(bert_request_success, false)) AS bert_requests_successful, round(coalesce(sum(bert_runtime_seconds), 0), 4) AS bert_runtime_seconds FROM {_USED} GROUP BY ALL"""


def _used(spark: SparkSession, folder: str) -> DataFrame:
    df = _missed(spark, folder)
    n = F.length(F.coalesce("full_text", F.lit("")))
    return df.withColumns({k: F.expr(v) for k, v in _TOKENS.items()} | {"llm_request_cost": (n % 100).cast("double") / 1e5, "llm_request_success": F.col("needs_llm_review") & (n % 9 > 0)})


@query(_USAGE)
def usage_summary(spark, folder):
    return metrics.usage(_used(spark, folder), ("run_id", "strategy"))


_RATIO = "CASE WHEN {1} > 0 THEN round(CAST({0} AS DOUBLE) / {1}, 9) ELSE 0.0 END"


@query(
    f"""WITH u AS ({_USAGE}), r AS (SELECT run_id, strategy, count(*) AS documents_total, count(*) FILTER (coalesce(needs_llm_review, false)) AS documents_sent_to_review FROM false_negatives GROUP BY ALL)
    SELECT u.*, documents_total, documents_sent_to_review, documents_total - documents_sent_to_review AS documents_resolved_locally, round(documents_sent_to_review / documents_total, 4) AS routing_rate, round((documents_total - documents_sent_to_review) / documents_total, 4) AS local_processing_rate,
    {_RATIO.format('bert_runtime_seconds', 'bert_requests_successful')} AS bert_average_runtime_seconds, {_RATIO.format('llm_reported_cost', 'documents_total')} AS cost_per_document, {_RATIO.format('llm_reported_cost', 'llm_requests_successful')} AS cost_per_llm_document,
    {_RATIO.format('llm_total_tokens', 'llm_requests_successful')} AS tokens_per_llm_document, {_RATIO.format('llm_reasoning_tokens', 'llm_completion_tokens')} AS reasoning_token_ratio FROM r JOIN u USING (run_id, strategy)"""
)
def cost_summary(spark, folder):
    by, df = ("run_id", "strategy"), _used(spark, folder)
    out = metrics.cost_summary(metrics.routing(df, by), metrics.usage(df, by), by)
    return out.withColumns({c: F.round(c, 9) for c in ("bert_average_runtime_seconds", "cost_per_document", "cost_per_llm_document", "tokens_per_llm_document", "reasoning_token_ratio")})


@query("SELECT strategy, CASE WHEN count(DISTINCT provider) = 1 THEN max(provider) END AS provider, CASE WHEN count(DISTINCT run_id) = 1 THEN max(run_id) END AS run_id FROM false_negatives GROUP BY strategy")
def metadata_passthrough(spark, folder):
    return _missed(spark, folder).groupBy("strategy").agg(metrics.single_value("provider").alias("provider"), metrics.single_value("run_id").alias("run_id"))


@query(f"SELECT lost, n_positive, routed, 1 - lost / greatest(n_positive, 1) AS recall FROM (SELECT count(*) FILTER (truth AND NOT detected_pii AND NOT needs_llm_review) AS lost, count(*) FILTER (truth) AS n_positive, avg(CAST(needs_llm_review AS DOUBLE)) AS routed FROM {_SCORED})")
def recoverable_recall(spark, folder):
    return metrics.recoverable_recall(_scored(spark, folder))


# Errors ---------------------------------------------------------------------------------------------------------

_TYPED = f"(SELECT *, CASE WHEN truth AND predicted_pii THEN 'TP' WHEN NOT truth AND NOT predicted_pii THEN 'TN' WHEN predicted_pii THEN 'FP' ELSE 'FN' END AS et FROM {_SCORED})"


@query(f'SELECT et AS error_type, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {_TYPED} GROUP BY et')
def error_summary(spark, folder):
    return errors.summary(errors.typed(_scored(spark, folder)))


_MISSED_TYPED = f"(SELECT *, CASE WHEN truth AND pred THEN 'TP' WHEN NOT truth AND NOT pred THEN 'TN' WHEN pred THEN 'FP' ELSE 'FN' END AS et FROM (SELECT *, {_TRUTH} AS truth, coalesce(predicted_pii, false) AS pred FROM false_negatives))"


@query(
    " UNION ALL ".join(
        f"""SELECT '{k}' AS summary, concat_ws(' | ', {', '.join(v)}) AS key, et AS error_type, count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY concat_ws(' | ', {', '.join(v)})), 4) AS share FROM {_MISSED_TYPED} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in v)} GROUP BY {', '.join(v)}, et"""
        for k, v in errors.KEY_SETS.items()
    )
)
def error_by_keys(spark, folder):
    return errors.grouped(errors.typed(_missed(spark, folder)))


@query(
    f"""SELECT *, round(correct / n, 4) AS accuracy, round(routed / n, 4) AS routing_rate, CASE WHEN positives > 0 THEN round((positives - missed_positives) / positives, 4) END AS recall FROM (
    SELECT difficulty, count(*) AS n, count(*) FILTER (truth) AS positives, count(*) FILTER (truth = predicted_pii) AS correct, count(*) FILTER (NOT truth AND predicted_pii) AS false_positives, count(*) FILTER (truth AND NOT predicted_pii) AS false_negatives,
    count(*) FILTER (truth AND NOT predicted_pii AND NOT needs_llm_review) AS missed_positives, count(*) FILTER (NOT truth AND predicted_pii AND NOT needs_llm_review) AS unreviewed_fp, count(*) FILTER (needs_llm_review) AS routed, round(avg(p), 4) AS mean_probability FROM {_SCORED} WHERE difficulty IS NOT NULL GROUP BY difficulty)"""
)
def slice_by_difficulty(spark, folder):
    return errors.slices(_scored(spark, folder), "difficulty", F.col("truth"), F.col("predicted_pii"), F.col("needs_llm_review"), "p")


# Thresholds -----------------------------------------------------------------------------------------------------

_STEPS = 201
_POINTS = f"pts AS (SELECT p, count(*) AS n, count(*) FILTER (truth) AS pos FROM {_SCORED} GROUP BY p)"
_CANDS = f"c AS (SELECT DISTINCT least(greatest(t, 0.0), 1.0) AS t FROM (SELECT CAST(p AS DOUBLE) AS t FROM pts UNION ALL SELECT (CAST(p AS DOUBLE) + lead(CAST(p AS DOUBLE)) OVER (ORDER BY p)) / 2 FROM pts UNION ALL SELECT i / {_STEPS - 1}.0::DOUBLE FROM range({_STEPS}) r(i)) WHERE t IS NOT NULL)"
_CUM = "cum AS (SELECT c.t, (SELECT sum(n) FROM pts) AS n_all, (SELECT sum(pos) FROM pts) AS n_pos, coalesce(sum(n) FILTER (CAST(p AS DOUBLE) < c.t), 0) AS n_below, coalesce(sum(pos) FILTER (CAST(p AS DOUBLE) < c.t), 0) AS pos_below, coalesce(sum(n) FILTER (CAST(p AS DOUBLE) <= c.t), 0) AS n_upto, coalesce(sum(pos) FILTER (CAST(p AS DOUBLE) <= c.t), 0) AS pos_upto FROM c, pts GROUP BY c.t)"


@query(f"SELECT round(sum(CASE WHEN truth THEN tp / rk END) / max(pos), 9) AS average_precision, max(rk) AS n, max(pos) AS n_positive FROM (SELECT truth, row_number() OVER w AS rk, sum(CAST(truth AS INT)) OVER w AS tp, count(*) FILTER (truth) OVER () AS pos FROM {_SCORED} WINDOW w AS (ORDER BY p DESC, truth ROWS UNBOUNDED PRECEDING))")
def average_precision(spark, folder):
    df = _scored(spark, folder)
    return thresholds.average_precision(df, "p", F.col("truth"), "truth").withColumn("average_precision", F.round("average_precision", 9))


@query(f"WITH {_POINTS}, {_CANDS}, {_CUM} SELECT t, CAST(n_pos - pos_below AS BIGINT) AS TP, CAST((n_all - n_below) - (n_pos - pos_below) AS BIGINT) AS FP, round(coalesce((n_pos - pos_below) / nullif(n_all - n_below, 0), 0), 6) AS precision, round(coalesce((n_pos - pos_below) / nullif(n_pos, 0), 0), 6) AS recall FROM cum")
def threshold_sweep(spark, folder):
    points = thresholds.scored(_scored(spark, folder), "p", F.col("truth"))
    return thresholds.sweep(thresholds.cumulative(points, thresholds.candidates(points, _STEPS))).select("t", "TP", "FP", "precision", "recall")


_TARGETS = [round(0.8 + i / 100, 2) for i in range(21)]


@query(
    f"""WITH {_POINTS}, {_CANDS}, {_CUM},
    g AS (SELECT unnest({_TARGETS}::DOUBLE[]) AS r),
    lo AS (SELECT g.r, t, n_all, n_below, pos_below FROM cum, g WHERE 1 - pos_below / n_pos >= g.r),
    hi AS (SELECT t, n_all - n_upto AS yes, (n_all - n_upto) - (n_pos - pos_upto) AS fp FROM cum WHERE n_all = n_upto OR round((n_pos - pos_upto) / (n_all - n_upto), 6) >= 0.15),
    b AS (SELECT lo.r AS recall_target, count(*) AS n_feasible_points, min({{'rf': round((lo.n_all - lo.n_below - hi.yes) / lo.n_all, 6), 'missed': lo.pos_below, 'fp': hi.fp, 'no': -lo.n_below, 'lo': lo.t, 'hi': hi.t}}) AS k FROM lo JOIN hi ON hi.t >= lo.t GROUP BY lo.r)
    SELECT recall_target, k.lo AS t_low, k.hi AS t_high, k.rf AS routed_fraction, CAST(k.missed AS BIGINT) AS missed, CAST(k.fp AS BIGINT) AS auto_yes_fp, n_feasible_points FROM b"""
)
def routing_frontier(spark, folder):
    return thresholds.frontier(_scored(spark, folder), "p", F.col("truth"), _TARGETS, 0.15, _STEPS).select("recall_target", "t_low", "t_high", "routed_fraction", "missed", "auto_yes_fp", "n_feasible_points")


_BUNDLE = ", ".join(
    f"round({a}, 6) AS {x}_precision, round({r}, 6) AS {x}_recall, round(coalesce(2 * {a} * {r} / nullif({a} + {r}, 0), 0), 6) AS {x}_f1"
    for x, a, r in (
        ("oracle", "coalesce(tp / nullif(tp + auto_yes_fp, 0), 0)", "coalesce(tp / nullif(n_positive, 0), 0)"),
        ("conservative", "coalesce(tp / nullif(tp + auto_yes_fp + routed_negatives, 0), 0)", "coalesce(tp / nullif(n_positive, 0), 0)"),
    )
)


@query(
    f"""SELECT * EXCLUDE (tp, no_right), {_BUNDLE}, 0.3::DOUBLE AS t_low, 0.7::DOUBLE AS t_high, n - n_positive AS n_negative, round(routed_n / n, 6) AS routed_fraction, n - routed_n AS auto_decided_n, round((n - routed_n) / n, 6) AS llm_call_reduction,
    round(1 - missed_positives / n_positive, 6) AS prefilter_recall, round(1 - auto_yes_fp / auto_yes_n, 6) AS auto_yes_precision, round(no_right / auto_no_n, 6) AS auto_no_npv FROM (SELECT *, n_positive - missed_positives AS tp FROM (
    SELECT count(*) AS n, count(*) FILTER (truth) AS n_positive, count(*) FILTER (p BETWEEN 0.3 AND 0.7) AS routed_n, count(*) FILTER (truth AND p < 0.3) AS missed_positives, count(*) FILTER (p > 0.7) AS auto_yes_n, count(*) FILTER (p > 0.7 AND NOT truth) AS auto_yes_fp,
    count(*) FILTER (p < 0.3) AS auto_no_n, count(*) FILTER (p < 0.3 AND NOT truth) AS no_right, count(*) FILTER (truth AND p BETWEEN 0.3 AND 0.7) AS routed_positives, count(*) FILTER (NOT truth AND p BETWEEN 0.3 AND 0.7) AS routed_negatives FROM {_SCORED}))"""
)
def evaluate_routing(spark, folder):
    return thresholds.evaluate(_scored(spark, folder), "p", F.col("truth"), 0.3, 0.7)


_LONG = " UNION ALL ".join(f"SELECT '{x}' AS label, CAST({_P} AS DOUBLE) AS p, {_TRUE.format(f'{x}_yes_no')} AS y FROM synthetic_records" for x in S.ENTITY_LABELS)


@query(
    f"""WITH l AS ({_LONG}), pts AS (SELECT label, p, count(*) AS n, count(*) FILTER (y) AS pos FROM l GROUP BY ALL), tot AS (SELECT label, sum(n) AS n, sum(pos) AS pos FROM pts GROUP BY label),
    c AS (SELECT DISTINCT label, t FROM (SELECT label, p AS t FROM pts UNION ALL SELECT label, (p + lead(p) OVER (PARTITION BY label ORDER BY p)) / 2 FROM pts UNION ALL SELECT label, i / {_STEPS - 1}.0::DOUBLE FROM tot, range({_STEPS}) r(i)) WHERE t IS NOT NULL),
    s AS (SELECT c.label, c.t, coalesce(sum(pts.n), 0) AS below, coalesce(sum(pts.pos), 0) AS lost FROM c LEFT JOIN pts ON pts.label = c.label AND pts.p < c.t GROUP BY ALL),
    m AS (SELECT s.label, t, tot.pos AS positives, tot.pos - lost AS tp, tot.n - below - (tot.pos - lost) AS fp FROM s JOIN tot USING (label)),
    f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS a, coalesce(tp / nullif(positives, 0), 0) AS r FROM m),
    b AS (SELECT label, max(positives) AS positives, max({{'f1': round(coalesce(2 * a * r / nullif(a + r, 0), 0), 6), 't': t}}) AS b FROM f GROUP BY label)
    SELECT label, CASE WHEN positives > 0 THEN round(b.t, 6) ELSE 0.5 END AS threshold, CASE WHEN positives > 0 THEN b.f1 ELSE 0.0 END AS f1, CAST(positives AS BIGINT) AS positives FROM b"""
)
def label_thresholds(spark, folder):
    df = _records(spark, folder).withColumn("p", _p())
    long = df.select("p", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), S.norm_bool(f"{x}_yes_no").alias("truth")) for x in S.ENTITY_LABELS])).alias("l")).select("p", "l.*")
    return thresholds.label_thresholds(long, steps=_STEPS)


@query(f"SELECT truth, CAST(least(floor(p * 40), 39) AS INT) AS bin, count(*) AS n FROM {_SCORED} GROUP BY ALL")
def score_histogram(spark, folder):
    return thresholds.histogram(_scored(spark, folder), "p", ("truth",))


# Exploration and splits -------------------------------------------------------------------------------------------

_KEY = r"md5(lower(trim(regexp_replace(coalesce(full_text, ''), '[\s\p{Z}\x{85}]+', ' ', 'g'))))"


@query(f"SELECT {_KEY} AS key, count(*) AS n, count(DISTINCT recommended_split) AS splits FROM synthetic_records GROUP BY ALL")
def duplicate_groups(spark, folder):
    return splits.duplicate_groups(_records(spark, folder), "full_text", "recommended_split")


@query(
    f"""SELECT CAST(sum(n) AS BIGINT) AS n_documents, count(*) AS n_unique_texts, CAST(sum(n - 1) AS BIGINT) AS n_duplicated_rows, count(*) FILTER (n > 1) AS n_duplicate_groups, coalesce(max(n) FILTER (n > 1), 0) AS largest_duplicate_group, count(*) FILTER (splits > 1) AS duplicate_groups_spanning_splits
    FROM (SELECT {_KEY} AS key, count(*) AS n, count(DISTINCT recommended_split) AS splits FROM synthetic_records GROUP BY ALL)"""
)
def duplicate_stats(spark, folder):
    return splits.duplicate_stats(_records(spark, folder), "full_text", "recommended_split")


_LEN = "length(coalesce(full_text, ''))"


@query(
    f"""SELECT CAST(min({_LEN}) AS INT) AS min, CAST(floor(quantile_cont({_LEN}, 0.5)) AS INT) AS median, CAST(floor(quantile_cont({_LEN}, 0.9)) AS INT) AS p90, CAST(floor(quantile_cont({_LEN}, 0.99)) AS INT) AS p99, CAST(max({_LEN}) AS INT) AS max,
    CAST(floor(max({_LEN}) / 3.5) AS INT) AS max_tokens, CAST(floor(quantile_cont({_LEN} / 3.5, 0.95)) AS INT) AS p95_tokens,
    CASE {' '.join(f'WHEN avg(CASE WHEN {_LEN} / 3.5 > {m} THEN 1.0 ELSE 0.0 END) <= {splits.TRUNCATION_TOLERANCE} THEN {m}' for m in splits.MAX_LENGTHS[:-1])} ELSE {splits.MAX_LENGTHS[-1]} END AS recommended_max_length, {', '.join(f'round(avg(CASE WHEN {_LEN} / 3.5 > {m} THEN 1.0 ELSE 0.0 END), 4) AS truncated_at_{m}' for m in splits.MAX_LENGTHS)} FROM synthetic_records"""
)
def length_stats(spark, folder):
    return splits.length_stats(_records(spark, folder), "full_text")


_CROSS = ["language", "scenario_type", "difficulty", "primary_pii_type", "document_type", "challenge_category"]


@query(
    'SELECT "column", value, n, positives, n - positives AS negatives, round(positives / n, 4) AS positive_rate FROM (' + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, count(*) FILTER ({_TRUTH}) AS positives FROM synthetic_records WHERE {c} IS NOT NULL GROUP BY {c}""" for c in _CROSS) + ")"
)
def crosstabs(spark, folder):
    return splits.crosstabs(_records(spark, folder), _CROSS, _truth())


@query(f"SELECT lower(trim(recommended_split)) AS split, count(*) AS n, count(*) FILTER ({_TRUTH}) AS positives, round(count(*) FILTER ({_TRUTH}) / count(*), 4) AS positive_rate, count(*) FILTER ({_TRUTH}) > 0 AND count(*) FILTER ({_TRUTH}) < count(*) AS usable FROM synthetic_records WHERE recommended_split IS NOT NULL GROUP BY ALL")
def split_report(spark, folder):
    return splits.split_report(_records(spark, folder), "recommended_split", _truth())


_DEAL = splits.deal_order({"train": 0.7, "validation": 0.15, "test": 0.15})


@query(
    f"""WITH g AS (SELECT {_KEY} AS key, bool_or({_TRUTH}) AS positive FROM synthetic_records GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY CAST('0x' || substr(md5(key || '42'), 1, 15) AS BIGINT), key) - 1 AS k FROM g)
    SELECT key, positive, {_DEAL}[CAST(k % {len(_DEAL)} AS INT) + 1] AS split FROM r"""
)
def stratified_split(spark, folder):
    """Each group of equal texts with its split; groups are put in order by a digest that both engines can compute."""
    order = F.conv(F.substring(F.md5(F.concat("key", F.lit("42"))), 1, 15), 16, 10).cast("long")
    return splits.stratified_split(_records(spark, folder), "full_text", _truth(), order=order)


@query(
    f"""WITH g AS (SELECT {_KEY} AS key, bool_or({_TRUTH}) AS positive FROM synthetic_records GROUP BY ALL),
    a AS (SELECT key, {_DEAL}[CAST((row_number() OVER (PARTITION BY positive ORDER BY CAST('0x' || substr(md5(key || '42'), 1, 15) AS BIGINT), key) - 1) % {len(_DEAL)} AS INT) + 1] AS split FROM g)
    SELECT document_id, split AS assigned_split, count(*) AS n FROM (SELECT document_id, {_KEY} AS key FROM synthetic_records) JOIN a USING (key) GROUP BY ALL"""
)
def split_assignment(spark, folder):
    """Every record with the split of its group."""
    df = _records(spark, folder)
    return splits.with_split(df, "full_text", stratified_split(spark, folder)).groupBy("document_id", "assigned_split").agg(F.count(F.lit(1)).alias("n"))


_WEIGHED = " UNION ALL ".join([f"SELECT 'DOCUMENT' AS label, {_TRUTH} AS y FROM synthetic_records", *[f"SELECT '{x}', {_TRUE.format(f'{x}_yes_no')} FROM synthetic_records" for x in S.ENTITY_LABELS]])


@query(
    f"""SELECT label, positives, n, round(positives / n, 4) AS rate, round(CASE WHEN label = 'DOCUMENT' THEN least(w, 20) ELSE greatest(least(w, 20), 1) END, 4) AS pos_weight
    FROM (SELECT *, CASE WHEN positives > 0 THEN (n - positives) / positives ELSE 20.0 END AS w FROM (SELECT label, count(*) FILTER (y) AS positives, count(*) AS n FROM ({_WEIGHED}) GROUP BY label))"""
)
def class_weights(spark, folder):
    return splits.class_weights(_records(spark, folder), _truth())


# Audits -----------------------------------------------------------------------------------------------------------


@query("SELECT document_id, count(*) AS n FROM synthetic_records WHERE document_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def audit_repeated_ids(spark, folder):
    return audit.repeated_ids(_records(spark, folder), "document_id")


@query(
    """SELECT document_id, 'manifest' AS missing_in FROM (SELECT document_id FROM synthetic_records WHERE document_id IS NOT NULL EXCEPT SELECT document_id FROM manifest)
    UNION ALL SELECT document_id, 'dataset' FROM (SELECT document_id FROM manifest WHERE document_id IS NOT NULL EXCEPT SELECT document_id FROM synthetic_records)"""
)
def audit_id_differences(spark, folder):
    return audit.id_differences(_records(spark, folder), table(spark, folder, "manifest"), "document_id")


_FIELDS = ["scenario_type", "language", "recommended_split", "difficulty"]


@query(" UNION ".join(f"SELECT d.document_id, '{f}' AS field, d.{f} AS dataset_value, m.{f} AS manifest_value FROM synthetic_records d JOIN manifest m USING (document_id) WHERE d.{f} IS DISTINCT FROM m.{f}" for f in _FIELDS))
def audit_alignment(spark, folder):
    return audit.aligned(_records(spark, folder), table(spark, folder, "manifest"), "document_id", _FIELDS)


@query("SELECT language AS value, count(*) AS n FROM synthetic_records WHERE language IS NULL OR language NOT IN ('en', 'de') GROUP BY ALL")
def audit_unknown_languages(spark, folder):
    return audit.unknown_values(_records(spark, folder), "language", ["en", "de"])


@query("SELECT CASE WHEN synthetic_generator IS NULL OR trim(synthetic_generator) = '' OR lower(trim(synthetic_generator)) = 'nan' THEN 'MISSING' ELSE synthetic_generator END AS value, count(*) AS n FROM synthetic_records GROUP BY ALL")
def audit_value_counts(spark, folder):
    return audit.value_counts(_records(spark, folder), "synthetic_generator")


_N = "(" + " + ".join(f"CAST({_TRUE.format(f'{x}_yes_no')} AS INT)" for x in S.ENTITY_LABELS) + ")"
_YES = "coalesce(lower(trim(contains_personal_data)) = 'yes', false)"


_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_TRUE.format(f'{x}_yes_no')} THEN '{x}' END" for x in S.ENTITY_LABELS) + "], lambda x: x IS NOT NULL)"
_RULES = {
    "positive_without_labels": f"{_YES} AND {_N} = 0",
    "negative_with_labels": f"NOT {_YES} AND {_N} > 0",
    "primary_type_differs": f"upper(coalesce(trim(primary_pii_type), '')) <> CASE {_N} WHEN 0 THEN 'NONE' WHEN 1 THEN {_LABELS}[1] ELSE 'MULTIPLE' END",
    "category_count_differs": f"category_count IS DISTINCT FROM {_N}",
    "pii_count_differs": f"pii_count IS DISTINCT FROM {_N}",
    "categories_differ": f"list_sort(list_filter(list_transform(string_split(coalesce(personal_data_categories, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) IS DISTINCT FROM list_sort({_LABELS})",
}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "check", count(*) FILTER ({v}) AS "count" FROM synthetic_records""" for k, v in _RULES.items()))
def audit_row_violations(spark, folder):
    return audit.row_violations(_records(spark, folder))


@query(
    rf"""SELECT document_id, array_to_string(list_filter([CASE WHEN regexp_matches(full_text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b') THEN 'email' END, CASE WHEN regexp_matches(full_text, 'https?://[^\s]+') THEN 'url' END,
    CASE WHEN regexp_matches(full_text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') THEN 'ip_address' END, CASE WHEN regexp_matches(full_text, '\b[A-Z]{{2}}\d{{2}}(?:\s?[A-Z0-9]){{10,30}}\b') THEN 'iban' END], lambda x: x IS NOT NULL), '|') AS kinds FROM synthetic_records
    WHERE NOT {_YES} AND (regexp_matches(full_text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b') OR regexp_matches(full_text, 'https?://[^\s]+') OR regexp_matches(full_text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') OR regexp_matches(full_text, '\b[A-Z]{{2}}\d{{2}}(?:\s?[A-Z0-9]){{10,30}}\b'))"""
)
def audit_leaking_negatives(spark, folder):
    return audit.leaking_negatives(_records(spark, folder), "document_id", "full_text").select("document_id", F.array_join("identifiers", "|").alias("kinds"))


@query(
    """WITH v AS (SELECT document_id, bool_and(coalesce(lower(variant) = 'blank', false)) AS blank FROM manifest WHERE document_id IS NOT NULL GROUP BY ALL)
    SELECT md5(full_text) AS text_md5, count(*) AS n, bool_and(coalesce(blank, false)) AS intended FROM synthetic_records LEFT JOIN v USING (document_id) WHERE full_text IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""
)
def audit_repeated_texts(spark, folder):
    return audit.repeated_texts(_records(spark, folder), table(spark, folder, "manifest"), "document_id", "full_text")


@query("SELECT scenario_type, " + ", ".join(f"count(*) FILTER (recommended_split = '{s}') AS {s}" for s in splits.SPLITS) + " FROM synthetic_records GROUP BY scenario_type")
def audit_scenario_by_split(spark, folder):
    return audit.pivot_counts(_records(spark, folder), "scenario_type", "recommended_split", list(splits.SPLITS))


def _finding(check: str, level: str, sql: str) -> str:
    return f"""SELECT '{check}' AS "check", CASE WHEN count(*) > 0 THEN '{level}' ELSE 'PASS' END AS level, count(*) AS "count" FROM ({sql})"""


_THIN = " UNION ALL ".join(f"SELECT 1 FROM synthetic_records WHERE {_TRUE.format(f'{x}_yes_no')} AND lower(trim(recommended_split)) = '{s}' HAVING count(*) < {audit.PRIORITY_TARGETS[s] if x in audit.PRIORITY else audit.LEAST_EXAMPLES}" for x in S.ENTITY_LABELS for s in splits.SPLITS)
_FINDINGS = " UNION ALL ".join(
    [
        _finding("repeated_ids", "FAIL", _SQL["audit_repeated_ids"]), _finding("repeated_manifest_ids", "FAIL", _SQL["audit_repeated_ids"].replace("synthetic_records", "manifest")), _finding("id_differences", "FAIL", _SQL["audit_id_differences"]),
        _finding("differing_fields", "FAIL", " UNION ".join(f"SELECT d.document_id, '{f}' AS field, d.{f} AS a, m.{f} AS b FROM synthetic_records d JOIN manifest m USING (document_id) WHERE d.{f} IS DISTINCT FROM m.{f}" for f in _FIELDS[:2])),
        _finding("identifiers_in_negatives", "WARN", _SQL["audit_leaking_negatives"]), _finding("repeated_texts", "WARN", f"SELECT * FROM ({_SQL['audit_repeated_texts']}) WHERE NOT intended"), _finding("thin_labels", "WARN", _THIN),
        _finding("unknown_language", "FAIL", _SQL["audit_unknown_languages"]), _finding("unknown_recommended_split", "FAIL", "SELECT recommended_split FROM synthetic_records WHERE recommended_split IS NULL OR recommended_split NOT IN ('train', 'validation', 'test') GROUP BY ALL"),
        f"""SELECT "check", CASE WHEN "count" > 0 THEN 'FAIL' ELSE 'PASS' END, "count" FROM ({_SQL['audit_row_violations']})""",
    ]
)


@query(_FINDINGS)
def audit_findings(spark, folder):
    return audit.audit(_records(spark, folder), table(spark, folder, "manifest"), "document_id", "full_text", {"language": ["en", "de"], "recommended_split": list(splits.SPLITS)}, ["document_id", "full_text", "contains_personal_data"])


@query(f"SELECT CASE WHEN count(*) FILTER (level = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (level = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (level = 'FAIL') AS failures, count(*) FILTER (level = 'WARN') AS warnings FROM ({_FINDINGS})")
def audit_status(spark, folder):
    return audit.status(audit_findings(spark, folder))


# Upgrade and plans --------------------------------------------------------------------------------------------------

_LOW = "lower(coalesce(full_text, ''))"
_BLANK = "({0} IS NULL OR trim({0}) = '' OR lower(trim({0})) = 'nan')"


@query(f"SELECT CASE WHEN {_BLANK.format('language')} THEN CASE WHEN {' OR '.join(f'''contains({_LOW}, '{t}')''' for t in S.GERMAN_TERMS)} THEN 'de' ELSE 'en' END ELSE language END AS language, count(*) AS n FROM synthetic_records GROUP BY ALL")
def upgrade_language(spark, folder):
    return _records(spark, folder).groupBy(S.infer_language("language", "full_text").alias("language")).agg(F.count(F.lit(1)).alias("n"))


_ALL = "concat_ws(' ', lower(coalesce(document_type, '')), lower(coalesce(file_name, '')), " + _LOW + ")"


@query("SELECT CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({_ALL}, '{w}')''' for w in ws)} THEN '{v}'" for ws, v in S.SCENARIO_RULES) + " ELSE 'general_document' END AS told, scenario_type, count(*) AS n FROM synthetic_records GROUP BY ALL")
def upgrade_scenario(spark, folder):
    return _records(spark, folder).groupBy(S.infer_scenario(F.lit(""), "document_type", "file_name", "full_text").alias("told"), "scenario_type").agg(F.count(F.lit(1)).alias("n"))


def _cases(text: str, rules, other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{value}'" for words, value in rules) + f" ELSE '{other}' END"


_TOLD = {
    "language": f"CASE WHEN {_BLANK.format('language')} THEN {_cases(_LOW, ((S.GERMAN_TERMS, 'de'),), 'en')} ELSE language END",
    "scenario_type": f"CASE WHEN {_BLANK.format('scenario_type')} THEN {_cases(_ALL, S.SCENARIO_RULES, 'general_document')} ELSE scenario_type END",
    "challenge_category": f"CASE WHEN NOT {_TRUE.format('edge_case')} THEN 'none' ELSE " + _cases("concat_ws(' ', lower(coalesce(labeling_notes, '')), " + _LOW + ")", S.CHALLENGE_RULES, "other_edge_case") + " END",
    "primary_pii_type": f"CASE WHEN {_BLANK.format('primary_pii_type')} THEN CASE {_N} WHEN 0 THEN 'NONE' WHEN 1 THEN {_LABELS}[1] ELSE 'MULTIPLE' END ELSE primary_pii_type END",
}


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _TOLD.items())}, count(*) AS n, CAST(sum(CASE WHEN coalesce(pii_count, 0) > 0 THEN pii_count ELSE coalesce(category_count, {_N}) END) AS BIGINT) AS pii_count FROM synthetic_records GROUP BY 1, 2, 3, 4")
def upgraded_dataset(spark, folder):
    df = upgrade.upgraded(_records(spark, folder).drop("challenge_category"))
    return df.groupBy("language", "scenario_type", "challenge_category", "primary_pii_type").agg(F.count(F.lit(1)).alias("n"), F.sum("pii_count").alias("pii_count"))


@query(
    """WITH t AS (SELECT scenario_type, count(*) AS total FROM synthetic_records WHERE scenario_type IS NOT NULL GROUP BY ALL), s AS (SELECT * FROM (VALUES ('test', 0.15), ('train', 0.7), ('validation', 0.15)) v(split, share)),
    x AS (SELECT *, CAST(total AS DOUBLE) * CAST(share AS DOUBLE) AS e FROM t, s), f AS (SELECT *, CAST(floor(e) AS BIGINT) AS b FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY scenario_type ORDER BY round(e - b, 9) DESC, split) AS k, total - sum(b) OVER (PARTITION BY scenario_type) AS l FROM f)
    SELECT scenario_type, split, b + CASE WHEN k <= l THEN 1 ELSE 0 END AS "count" FROM r"""
)
def largest_remainder(spark, folder):
    totals = _records(spark, folder).where("scenario_type is not null").groupBy("scenario_type").agg(F.count(F.lit(1)).alias("total"))
    shares = spark.createDataFrame(list(planner.SPLIT_SHARES.items()), "split string, share double")
    return planner.allocate_table(totals.crossJoin(F.broadcast(shares)), "scenario_type", F.col("total"), "split", F.col("share"))


def _combinations(spark: SparkSession, folder: str) -> dict[str, list[list[str]]]:
    """Entity combinations of each scenario as the manifest has them, all of them: sets of known labels are at most
    4,096, and the scenarios are those of the sampling targets."""
    names = table(spark, folder, "sample_targets").where("field = 'scenario'").select(F.col("category").alias("scenario_type")).distinct()
    known = F.array(*map(F.lit, S.ENTITY_LABELS))
    rows = table(spark, folder, "manifest").select("scenario_type", F.array_distinct(F.array_intersect(S.label_list("entity_types"), known)).alias("c")).where(F.size("c") > 0).join(F.broadcast(names), "scenario_type").distinct().orderBy("scenario_type", "c").collect()
    out: dict[str, list[list[str]]] = {}
    for r in rows:
        out.setdefault(r["scenario_type"], []).append(r["c"])
    return out


def _plan(spark: SparkSession, folder: str) -> tuple[list[dict], list[str]]:
    combos = _combinations(spark, folder)
    rows = [r for i, s in enumerate(sorted(combos)) for r in planner.scenario_plan(s, i, 100, combos[s], ["filled_a", "filled_b", "blank"])]
    targets = {e: audit.PRIORITY_TARGETS if e in audit.PRIORITY else dict.fromkeys(splits.SPLITS, audit.LEAST_EXAMPLES) for e in S.ENTITY_LABELS}
    return planner.top_up(rows, combos, targets)


@query()
def generation_plan(spark, folder):
    return planner.plan_table(spark, _plan(spark, folder)[0]).withColumn("entity_types", F.array_join("entity_types", ";"))


@query()
def plan_violations(spark, folder):
    return planner.plan_violations(planner.plan_table(spark, _plan(spark, folder)[0]))


@query()
def generated_documents(spark, folder):
    docs = planner.documents(planner.plan_table(spark, _plan(spark, folder)[0]), S.ENTITY_LABELS)
    return docs.select("document_id", "scenario", "language", "recommended_split", "primary_pii_type", "pii_count", "full_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("@LABELS@", _LABEL_ROWS) for k, v in _SQL.items()}


