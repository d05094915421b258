"""Queries of detection, fusion, routing and review, each with SQL, on evidence that exercises every branch.

The texts of the tables hold few of the rarer items and the stored evidence is dates alone. So these queries put
items into the texts, or lay out evidence, by arithmetic on each text's length that both engines compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import detect, fusion, recognise, review
from veilspark.operators.detect import SPANS
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


_N = "length(coalesce(full_text, ''))"

# Texts with items in them --------------------------------------------------------------------------------------

#: What is put behind a text, by its length; valid in both engines.
_ADDED = (
    f"CASE WHEN {_N} % 3 = 0 THEN concat(' Konto DE44', lpad(CAST({_N} * 7919 AS STRING), 18, '5'), ' offen') ELSE '' END",
    f"CASE WHEN {_N} % 4 = 1 THEN concat(' Arztnummer ', CAST({_N} AS STRING), ', medical  id') ELSE '' END",
    f"CASE WHEN {_N} % 5 = 2 THEN ' a Swiss and a DUTCH form, französisch.' ELSE '' END",
    f"CASE WHEN {_N} % 7 = 3 THEN concat(' P', lpad(CAST({_N} AS STRING), 8, '7'), ' and card 4000 1234 5678 ', lpad(CAST({_N} AS STRING), 4, '9')) ELSE '' END",
)
_FULL = f"concat(coalesce(full_text, ''), {', '.join(_ADDED)})"
_TEXTS = f"(SELECT document_id, {_FULL.replace('AS STRING', 'AS VARCHAR')} AS t FROM synthetic_records)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "synthetic_records").select("document_id", F.expr(_FULL).alias("t"))


def _ascii(pattern: str) -> str:
    """The same pattern for an engine without Unicode flags."""
    return pattern.replace("(?iuU)", "(?i)").replace("(?uU)", "").replace("'", "''")


def _placed(kind: str) -> str:
    """Each match with its place: the pieces before it and the matches before it, added up."""
    p = _ascii(detect.PATTERNS[kind])
    start = "coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    return (
        f"SELECT document_id, '{kind}' AS type, found[i] AS value, CAST({start} AS INT) AS start FROM (SELECT document_id, found, pieces, unnest(range(1, len(found) + 1)) AS i "
        f"FROM (SELECT document_id, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS pieces FROM {_TEXTS} WHERE regexp_matches(t, '\\S')))"
    )


_PLAIN = [k for k in detect.PATTERNS if k != "PHONE_NUMBER"]


@query(f"SELECT document_id, type, value, start, CAST(start + length(value) AS INT) AS \"end\", count(*) AS n FROM ({' UNION ALL '.join(map(_placed, _PLAIN))}) GROUP BY ALL")
def detect_offsets(spark, folder):
    """Every match of all detectors but phones, with its place."""
    every = F.concat(*[detect.spans("t", detect.PATTERNS[k], k) for k in _PLAIN])
    return detect.explode_spans(_texts(spark, folder), "document_id", every).groupBy("document_id", "type", "value", "start", "end").agg(F.count(F.lit(1)).alias("n"))


def _values(name: str, kind: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return detect.explode_spans(_texts(spark, folder), "document_id", detect.spans("t", detect.PATTERNS[kind], kind)).groupBy("document_id", "value").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = name
    query(f"SELECT document_id, value, count(*) AS n FROM (SELECT document_id, unnest(regexp_extract_all(t, '{_ascii(detect.PATTERNS[kind])}')) AS value FROM {_TEXTS}) GROUP BY ALL")(run)


for _name, _kind in (("detect_iban", "IBAN_CODE"), ("detect_medical", "MEDICAL_LICENSE"), ("detect_nationality", "NRP")):
    _values(_name, _kind)

_PHONE_CASES = (
    ("+49 (0)171 39200-78", "+49 (0)171 39200-78"), ("0049 30 1234567", "0049 30 1234567"), ("(040) 66969 623", "(040) 66969 623"), ("415.555.0165 x400", "415.555.0165 x400"), ("+1 415-555-0187", "+1 415-555-0187"),
    ("call 030/12", None), ("01-02-2024", None), ("2024-01-02", None), ("5559166942", None), ("0 1", None), ("1415.555.01650", None), ("(415) 555 0187 ext. 22", "(415) 555 0187 ext. 22"),
)


@query("SELECT document_id, value, count(*) AS n FROM (SELECT document_id, unnest([" + ", ".join(f"'{w}'" for _, w in _PHONE_CASES if w) + "]) AS value FROM synthetic_records) GROUP BY ALL")
def detect_phone_formats(spark, folder):
    """Each record with the same lines of numbers: those that are phones, and dates, codes and short numbers that aren't."""
    lines = F.lit("\n\n".join(f"Nr: {t} ." for t, _ in _PHONE_CASES))
    df = table(spark, folder, "synthetic_records").select("document_id", lines.alias("t"))
    return detect.explode_spans(df, "document_id", detect.phone_spans("t")).groupBy("document_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT document_id, array_to_string(list_transform(list_filter([{', '.join(f"regexp_extract(t, '{_ascii(p)}')" for p in (detect.PATTERNS['PASSPORT'], detect.PATTERNS['IBAN_CODE']))}], lambda x: x <> ''), lambda x: x), '|') AS unexpected FROM {_TEXTS}
    WHERE regexp_matches(t, '{_ascii(detect.PATTERNS['PASSPORT'])}') OR regexp_matches(t, '{_ascii(detect.PATTERNS['IBAN_CODE'])}')"""
)
def unexpected_values(spark, folder):
    """First passport and account of each text that its (empty) list of allowed values doesn't hold."""
    none = F.array().cast("array<string>")
    first = [F.slice(detect.unexpected_literals("t", none, detect.PATTERNS[k]), 1, 1) for k in ("PASSPORT", "IBAN_CODE")]
    return _texts(spark, folder).select("document_id", F.array_join(F.concat(*first), "|").alias("unexpected")).where("unexpected <> ''")


@query(f"SELECT document_id, array_to_string(list_filter(['Arztnummer', 'Konto', 'Swiss'], lambda v: NOT contains(t, v)), '|') AS missing, count(*) AS n FROM {_TEXTS} GROUP BY ALL")
def missing_values(spark, folder):
    """Required words that a text lacks."""
    required = F.array(*map(F.lit, ("Arztnummer", "Konto", "Swiss")))
    return _texts(spark, folder).groupBy("document_id", F.array_join(detect.missing_literals("t", required), "|").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


# Evidence laid out ------------------------------------------------------------------------------------------------

_KINDS = ("PERSON", "EMAIL_ADDRESS", "DATE_TIME", "LOCATION", "PASSPORT", "NRP", "PHONE_NUMBER", "IBAN_CODE", "URL")
#: Of each kind: whether the recogniser and the patterns report it, with which score, and where.
_NER = [(k, f"({_N} + 3 * {i}) % {14 if k in fusion.STRONG else 5} = 0", f"CAST({_N} * {i + 1} % 50 AS DOUBLE) / 100 + 0.4e0", f"{_N} * {i + 7} % 900") for i, k in enumerate(_KINDS)]
_PATTERN = [(k, f"({_N} + 5 * {i}) % {21 if k in fusion.STRONG else 4} = 0", "0.9e0", f"{_N} * {i + 3} % 900") for i, k in enumerate(_KINDS)]


def _evidence(rows: list, source: str) -> Column:
    spans = [F.when(F.expr(c), F.struct(F.lit(k).alias("type"), F.lit("v").alias("value"), F.expr(score).alias("confidence"), F.lit(source).alias("source"), F.expr(at).cast("int").alias("start"), F.expr(f"{at} + 10").cast("int").alias("end"))) for k, c, score, at in rows]
    return F.array_compact(F.array(*spans)).cast(SPANS)


def _sql_evidence(rows: list) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {{'type': '{k}', 'conf': {score}, 'a': {at}, 'b': {at} + 10}} END" for k, c, score, at in rows) + "], lambda s: s IS NOT NULL)"


_LAID = f"(SELECT row_number() OVER () AS row, document_id, {_sql_evidence(_NER)} AS ner, {_sql_evidence(_PATTERN)} AS pat FROM synthetic_records)"
_NEAR = "list_filter(l, lambda d: d.type <> 'DATE_TIME' OR len(list_filter(l, lambda s: s.type IN ('PERSON', 'LOCATION') AND (abs(s.a - d.b) <= 200 OR abs(d.a - s.b) <= 200))) > 0)"
_in = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_FUSED = f"""WITH r AS {_LAID}, e AS (SELECT row, document_id, {_NEAR} AS l, list_intersect(list_transform(ner, lambda s: s.type), list_transform(pat, lambda s: s.type)) AS agreed FROM (SELECT *, list_concat(ner, pat) AS l FROM r)),
    s AS (SELECT row, agreed, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS pos FROM e),
    t AS (SELECT row, s.type AS type, min(pos) AS pos, max(CASE WHEN list_contains(agreed, s.type) THEN least(1.0, s.conf + 0.3) ELSE s.conf END) AS conf FROM s GROUP BY row, s.type),
    g AS (SELECT row, string_agg(type || '=' || CAST(CAST(round(conf * 10000) AS INT) AS VARCHAR), '|' ORDER BY pos) AS confs, string_agg(type, '|' ORDER BY type) AS categories, coalesce(string_agg(type, '|' ORDER BY pos) FILTER (type IN {_in(fusion.STRONG)}), '') AS strong, coalesce(string_agg(type, '|' ORDER BY pos) FILTER (type IN {_in(fusion.POTENTIAL)}), '') AS potential FROM t GROUP BY row),
    f AS (SELECT document_id, len(l) AS n_entities, coalesce(confs, '') AS confs, coalesce(categories, '') AS categories, coalesce(strong, '') AS strong, coalesce(potential, '') AS potential FROM e LEFT JOIN g USING (row))"""
_ROUTE = "CASE WHEN strong <> '' THEN 'local_pii' WHEN potential <> '' THEN 'low_cost_llm' ELSE 'local_non_pii' END AS route, CASE WHEN strong <> '' THEN 'strong_pii_detected' WHEN potential <> '' THEN 'potential_pii_evidence' ELSE 'no_meaningful_signal' END AS reason"


def _laid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "synthetic_records").select("document_id", _evidence(_NER, "ner").alias("ner"), _evidence(_PATTERN, detect.PATTERN_SOURCE).alias("patterns"))


@query(f"{_FUSED} SELECT document_id, CAST(n_entities AS INT) AS n_entities, confs, categories, strong, potential, {_ROUTE}, strong <> '' AS detected, strong <> '' OR potential <> '' AS detected_any, strong = '' AND potential <> '' AS needs_review, count(*) AS n FROM f GROUP BY ALL")
def fusion_documents(spark, folder):
    """Boost where both detectors agree, best score per type, order of first report, category lists, flags and routes."""
    out = fusion.route(fusion.fuse(_laid(spark, folder), "patterns", "ner"))
    confs = F.array_join(F.transform(F.map_entries("per_type_conf"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("int").cast("string"))), "|")
    lists = {k: F.array_join(c, "|") for k, c in (("categories", "detected_categories"), ("strong", "strong_pii_categories"), ("potential", "potential_pii_categories"))}
    return out.select("document_id", F.size("entities").alias("n_entities"), confs.alias("confs"), *[v.alias(k) for k, v in lists.items()], "route", F.col("routing_reason").alias("reason"), F.col("detected_pii").alias("detected"), F.col("detected_any_pii").alias("detected_any"), F.col("needs_llm_review").alias("needs_review")).groupBy(
        "document_id", "n_entities", "confs", "categories", "strong", "potential", "route", "reason", "detected", "detected_any", "needs_review"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_FUSED} SELECT route, reason AS routing_reason, count(*) AS n FROM (SELECT {_ROUTE} FROM f) GROUP BY ALL")
def fusion_routes(spark, folder):
    return fusion.route(fusion.fuse(_laid(spark, folder), "patterns", "ner")).groupBy("route", "routing_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT document_id, CAST(sum(len(l)) AS BIGINT) AS spans, CAST(sum(len({_NEAR})) AS BIGINT) AS kept FROM (SELECT document_id, list_concat(ner, pat) AS l FROM {_LAID}) GROUP BY document_id")
def date_proximity(spark, folder):
    """Dates stay only near a person or a place: spans before and after, per document."""
    df = _laid(spark, folder).withColumn("l", F.concat("ner", "patterns"))
    return df.select("document_id", F.size("l").alias("a"), F.size(fusion.near_dates(F.col("l"))).alias("b")).groupBy("document_id").agg(F.sum("a").alias("spans"), F.sum("b").alias("kept"))


@query(
    f"""SELECT document_id, CAST(sum(len(list_filter(l, lambda s: s.type <> 'PHONE_NUMBER' OR len(list_filter(l, lambda i: i.type = 'IBAN_CODE' AND s.a < i.b AND s.b > i.a)) = 0))) AS BIGINT) AS kept, CAST(sum(len(l)) AS BIGINT) AS spans FROM (SELECT document_id, list_concat(ner, pat) AS l FROM {_LAID}) GROUP BY document_id"""
)
def phones_in_ibans(spark, folder):
    """Phone spans that overlap an account's span are left out."""
    df = _laid(spark, folder).withColumn("l", F.concat("ner", "patterns"))
    return df.select("document_id", F.size("l").alias("a"), F.size(detect.without_phones_in_ibans(F.col("l"))).alias("b")).groupBy("document_id").agg(F.sum("b").alias("kept"), F.sum("a").alias("spans"))


_REPORTS = ("Anna", "Anna Berg", "HR-12", "Q3", "Dr. Prof.", "prof. Berlin", "Berlin", "x@y.example", "ab", "a.b")
_REPORTED = [(k, i, f"{_N} % {i + 2} = 0", f"CAST({_N} * {i + 3} % 100 AS DOUBLE) / 100") for i, k in enumerate(("PERSON", "LOCATION", "PERSON", "LOCATION", "LOCATION", "COLOUR", "PHONE_NUMBER", "URL"))]
_VALUE = "[" + ", ".join(f"'{v}'" for v in _REPORTS) + "][CAST(({n} + {i}) % 10 AS INT) + 1]"


@query(
    "WITH s AS (SELECT document_id, "
    + "list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN {{'type': '{k}', 'v': {_VALUE.format(n=_N, i=i)}, 'conf': {conf}}} END" for k, i, c, conf in _REPORTED)
    + """], lambda s: s IS NOT NULL) AS l FROM synthetic_records)
    SELECT document_id, array_to_string(list_transform(list_filter(l, lambda s: s.conf >= 0.5 AND s.type <> 'COLOUR' AND (s.type <> 'PERSON' OR contains(s.v, ' ')) AND (s.type <> 'LOCATION' OR NOT (contains(s.v, '@') OR regexp_full_match(s.v, '[A-Z]{2,6}-\\d+') OR regexp_full_match(s.v, 'Q[1-4]') OR length(replace(s.v, '.', '')) <= 2 OR starts_with(lower(s.v), 'univ.') OR starts_with(lower(s.v), 'prof.')))),
      lambda s: s.type || ':' || s.v), '|') AS kept, count(*) AS n FROM s GROUP BY ALL"""
)
def reports_kept(spark, folder):
    """What stays of a recogniser's report: sure scores, known types, names of two words, no false places."""
    spans = [
        F.when(F.expr(c), F.struct(F.lit(k).alias("type"), F.element_at(F.array(*map(F.lit, _REPORTS)), ((F.expr(_N) + i) % 10 + 1).cast("int")).alias("value"), F.expr(conf).alias("confidence"), F.lit("r").alias("source"), F.lit(5).alias("start"), F.lit(9).alias("end")))
        for k, i, c, conf in _REPORTED
    ]
    df = table(spark, folder, "synthetic_records").select("document_id", "full_text", F.array_compact(F.array(*spans)).cast(SPANS).alias("l"))
    kept = recognise.kept(F.col("l"), F.lit("no code here"))
    return df.groupBy("document_id", F.array_join(F.transform(kept, lambda s: F.concat(s["type"], F.lit(":"), s["value"])), "|").alias("kept")).agg(F.count(F.lit(1)).alias("n"))


# Review -------------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


@query(
    rf"""WITH r AS (SELECT row_number() OVER () AS row, document_id, full_text, entities FROM false_negatives),
    s AS (SELECT row, greatest(0, e.start - 200) AS a, least(length(full_text), e."end" + 200) AS b FROM (SELECT row, full_text, unnest(entities) AS e FROM r)),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY row ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY row ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
    w AS (SELECT row, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL),
    t AS (SELECT row, string_agg({_STRIP.format('substr(full_text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY island) AS t FROM w JOIN r USING (row) GROUP BY row)
    SELECT document_id, md5(CASE WHEN NOT coalesce(regexp_matches(full_text, '[^\s\p{{Z}}]'), false) THEN '' ELSE coalesce(t, full_text) END) AS text_md5, count(*) AS n FROM r LEFT JOIN t USING (row) GROUP BY ALL"""
)
def review_texts(spark, folder):
    """The text that a reviewer gets for every document: all merged windows, or the whole."""
    return table(spark, folder, "false_negatives").groupBy("document_id", F.md5(review.review_text("full_text", "entities")).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = (
    ('{"contains_pii": true, "reason": "name"}', True, "name", True), ('Sure! {"contains_pii": "TRUE", "reason": "x"} done', True, "x", True), ('{"contains_pii": , "reason": "y"}', False, "y", True),
    ("no json", False, "No JSON found in response: no json", False), ('{"contains_pii": tru', False, 'No JSON found in response: {"contains_pii": tru', False), (None, False, "No JSON found in response: ", False), ('{"contains_pii": 1}', True, "", True),
    ('{"contains_pii": "no", "reason": null}', False, "", True), ('{bad} {"contains_pii": true}', False, 'JSON parse error. Raw response: {bad} {"contains_pii": true}', False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(p).lower()}, '{r}', {str(ok).lower()})" for i, (_, p, r, ok) in enumerate(_ANSWERS)) + ") v(id, contains_pii, reason, success)")
def review_answers(spark, folder):
    """Readings of answers in all the shapes that models give."""
    rows = [(i, a[0]) for i, a in enumerate(_ANSWERS)]
    return spark.createDataFrame(rows, "id int, answer string").select("id", review.read_answer("answer").alias("a")).select("id", "a.*")


@query(
    rf"""WITH r AS (SELECT document_id, {_STRIP.format("coalesce(full_text, '')")} AS t, full_text FROM false_negatives WHERE needs_llm_review AND coalesce(regexp_matches(full_text, '[^\s\p{{Z}}]'), false))
    SELECT document_id, contains(full_text, '@') OR length(regexp_replace(full_text, '\D', '', 'g')) >= 9 AS llm_pii, true AS llm_request_success, count(*) AS n FROM r GROUP BY ALL"""
)
def reviews_whole(spark, folder):
    """The offline reviewer on the flagged documents' whole texts; documents without a flag or text aren't asked."""
    df = table(spark, folder, "false_negatives").withColumn("entities", F.array().cast(SPANS)).withColumn("full_text", F.regexp_replace("full_text", ":\n", ": "))
    got = review.run_reviews(df, "document_id", "full_text", "entities", "needs_llm_review", "stub")
    return got.groupBy(F.col("id").alias("document_id"), "llm_pii", "llm_request_success").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
