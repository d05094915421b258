"""Queries of sources and sinks (written and read again), scalar rules, upgrades, plans, registries and comparisons."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.functions.materialize import ensure_checkpoint_dir
from veilspark.operators import audit, compare, decide, errors, fusion, metrics, planner, rewrite, splits, upgrade
from veilspark.plans.privacy import _LABELS, _N, _TRUE, _TRUTH, _missed, _records, _scored
from veilspark.sources import runs, sheets
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


def _folder(spark: SparkSession) -> str:
    """A new folder among the session's shared checkpoints, removed when its JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# Sources and sinks ------------------------------------------------------------------------------------------------

_READ = "document_id, md5(coalesce(full_text, '')) AS text_md5, coalesce(language, '') AS language, pii_count, CAST(file_created_date AS VARCHAR) AS created, count(*) AS n"


def _read_back(df: DataFrame) -> DataFrame:
    keys = [F.col("document_id"), F.md5(F.coalesce("full_text", F.lit(""))).alias("text_md5"), F.coalesce("language", F.lit("")).alias("language"), F.col("pii_count"), F.col("file_created_date").cast("string").alias("created")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_READ} FROM synthetic_records GROUP BY ALL")
def io_dataset_csv(spark, folder):
    """The whole dataset as quoted CSV with line breaks in the texts, read again with its types."""
    path = _folder(spark)
    runs.write_csv(_records(spark, folder), path)
    return _read_back(runs.read_dataset(spark, path))


@query(f"SELECT {_READ} FROM synthetic_records GROUP BY ALL")
def io_dataset_parquet(spark, folder):
    path = _folder(spark) + "/data.parquet"
    _records(spark, folder).write.parquet(path)
    return _read_back(runs.read_dataset(spark, path))


@query("SELECT document_id, md5(coalesce(full_text, '')) AS text_md5, coalesce(document_type, '') AS document_type, count(*) AS n FROM synthetic_records GROUP BY ALL")
def io_csv_with_mark(spark, folder):
    """CSV with a byte order mark, read again."""
    path = _folder(spark)
    runs.write_csv(_records(spark, folder).select("document_id", "full_text", "document_type"), path, bom=True)
    df = runs.read_csv_with_mark(spark, path)
    return df.groupBy("document_id", F.md5(F.coalesce("full_text", F.lit(""))).alias("text_md5"), F.coalesce("document_type", F.lit("")).alias("document_type")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT document_id, count(*) AS n, sum(CASE WHEN contains(full_text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS multiline FROM synthetic_records GROUP BY ALL")
def preview_lines(spark, folder):
    """Line breaks as two signs: a document counts as multi-line by these signs, and none is left."""
    df = upgrade.preview(_records(spark, folder), "full_text")
    marked = F.when(F.contains("full_text", F.lit("\\n")) & ~F.contains("full_text", F.lit("\n")), 1).otherwise(0)
    return df.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(marked).alias("multiline"))


@query(f"SELECT {', '.join(f'count(*) AS {x}_no' for x in ('URL', 'NRP'))}, count(*) FILTER (full_text IS NULL OR full_text = '') AS empty_texts, count(*) FILTER ({_TRUE.format('PERSON_yes_no')}) AS people FROM synthetic_records")
def io_training_view(spark, folder):
    """Absent label columns count as no, null texts are empty."""
    df = runs.for_training(_records(spark, folder).drop("URL_yes_no", "NRP_yes_no"))
    return df.agg(*[F.count_if(F.col(f"{x}_yes_no") == "no").alias(f"{x}_no") for x in ("URL", "NRP")], F.count_if(F.col("full_text") == "").alias("empty_texts"), F.count_if(S.norm_bool("PERSON_yes_no")).alias("people"))


@query("SELECT document_id, language FROM (SELECT document_id, language FROM synthetic_records ORDER BY document_id NULLS FIRST LIMIT 100)")
def io_first_rows(spark, folder):
    """A limit takes the first rows in order of the id."""
    path = _folder(spark) + "/data.parquet"
    _records(spark, folder).select("document_id", "language").groupBy("document_id").agg(F.max("language").alias("language")).write.parquet(path)
    return runs.read_dataset(spark, path, limit=100).select("document_id", "language")


_SQL["io_first_rows"] = "SELECT document_id, max(language) AS language FROM synthetic_records GROUP BY document_id ORDER BY document_id NULLS FIRST LIMIT 100"


@query("SELECT run_id, strategy AS output_name, count(*) AS n, count(*) FILTER (is_correct) AS correct, run_id = (SELECT max(run_id) FROM false_negatives) AS latest FROM false_negatives GROUP BY ALL")
def io_runs(spark, folder):
    """Every run's outputs saved by run and name, found again as one table; the latest run is the greatest id."""
    path, df = _folder(spark), _missed(spark, folder)
    names = df.where("run_id is not null and strategy is not null").select("run_id", "strategy").distinct().collect()  # runs are a few
    for r in names:
        runs.write_output(df.where((F.col("run_id") == r["run_id"]) & (F.col("strategy") == r["strategy"])), path, r["run_id"], r["strategy"])
    last = runs.latest_run(spark, path)
    return runs.read_outputs(spark, path).groupBy("run_id", "output_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.lit(None).alias("latest")).withColumn("latest", F.col("run_id") == last)


@query("SELECT et AS error_type, count(*) AS n FROM (SELECT CASE WHEN truth AND pred THEN 'TP' WHEN NOT truth AND NOT pred THEN 'TN' WHEN pred THEN 'FP' ELSE 'FN' END AS et FROM (SELECT " + _TRUTH + " AS truth, coalesce(predicted_pii, false) AS pred FROM false_negatives)) GROUP BY et")
def io_error_parts(spark, folder):
    """Predictions saved in a folder for each type of error."""
    path = _folder(spark)
    runs.write_parts(errors.typed(_missed(spark, folder)), path, "error_type")
    return spark.read.parquet(path).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'run' AS key, 'a \"b\" ü' AS value UNION ALL SELECT 'missing', '{}' UNION ALL SELECT 'n', '3'")
def io_metadata(spark, folder):
    """A run's metadata as JSON; a missing file is empty."""
    path = _folder(spark)
    runs.write_json(spark, {"run": 'a "b" ü', "n": 3}, f"{path}/meta.json")
    got = runs.read_json(spark, f"{path}/meta.json")
    return spark.createDataFrame([("run", got["run"]), ("n", str(got["n"])), ("missing", str(runs.read_json(spark, f"{path}/none.json")))], "key string, value string")


@query(f"SELECT 'records' AS benchmark, count(*) AS documents, count(*) FILTER (truth) AS positives FROM (SELECT {_TRUTH} AS truth FROM synthetic_records) UNION ALL SELECT 'missed', count(*), count(*) FILTER ({_TRUTH}) FROM false_negatives")
def io_benchmarks(spark, folder):
    """Metric rows of two benchmarks saved and read as one table."""
    path = _folder(spark)
    for name, df in (("records", _scored(spark, folder)), ("missed", _missed(spark, folder))):
        runs.save_benchmark(metrics.stage_metrics(df), path, name)
    got = runs.load_benchmarks(spark, path).where("stage = 'standardized'")
    return got.select("benchmark", F.col("n").alias("documents"), (F.col("TP") + F.col("FN")).alias("positives"))


@query(
    """SELECT 'repeated_ids' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS level, count(*) AS "count" FROM (SELECT document_id FROM synthetic_records WHERE document_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'repeated_manifest_ids', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM (SELECT document_id FROM manifest WHERE document_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""
)
def io_audit_report(spark, folder):
    """An audit's findings as a JSON report, read again."""
    path = _folder(spark)
    findings = [audit.finding(audit.repeated_ids(table(spark, folder, t), "document_id").agg(F.count(F.lit(1)).alias("count")), c, "FAIL") for t, c in (("synthetic_records", "repeated_ids"), ("manifest", "repeated_manifest_ids"))]
    runs.write_audit(spark, findings[0].unionByName(findings[1]), f"{path}/audit.json")
    rows = runs.read_json(spark, f"{path}/audit.json")["findings"]
    return spark.createDataFrame([(r["check"], r["level"], r["count"]) for r in rows], "check string, level string, count long")


@query("SELECT strategy, count(*) AS n FROM false_negatives GROUP BY strategy")
def io_reports(spark, folder):
    """Reports saved under their names."""
    path = _folder(spark)
    runs.save_reports({"by_strategy": _missed(spark, folder).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.parquet(f"{path}/by_strategy")


# Scalar rules and upgrades -----------------------------------------------------------------------------------------

_BLANK = "({0} IS NULL OR trim({0}) = '' OR lower(trim({0})) = 'nan')"


@query(
    f"""SELECT CASE WHEN {_N} = 0 THEN 'NONE' WHEN {_N} = 1 THEN {_LABELS}[1] ELSE 'MULTIPLE' END AS told_primary, CASE WHEN coalesce(pii_count, 0) > 0 THEN pii_count ELSE coalesce(category_count, {_N}) END AS told_count, count(*) AS n FROM synthetic_records GROUP BY ALL"""
)
def infer_labels(spark, folder):
    labels = S.active_labels()
    return _records(spark, folder).groupBy(S.infer_primary(F.lit(""), labels).alias("told_primary"), S.infer_count("pii_count", "category_count", labels).alias("told_count")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT CASE WHEN NOT {_TRUE.format('edge_case')} THEN 'none' {' '.join(f"WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in ws)} THEN '{v}'" for ws, v in S.CHALLENGE_RULES)} ELSE 'other_edge_case' END AS told, count(*) AS n
    FROM (SELECT edge_case, concat_ws(' ', lower(coalesce(labeling_notes, '')), lower(coalesce(full_text, ''))) AS t FROM synthetic_records) GROUP BY ALL"""
)
def upgrade_challenge(spark, folder):
    return _records(spark, folder).groupBy(S.infer_challenge(F.lit(""), "edge_case", "labeling_notes", "full_text").alias("told")).agg(F.count(F.lit(1)).alias("n"))


_LIST = "array_to_string(list_sort(list_filter(list_transform(string_split(coalesce({0}, ''), ';'), lambda x: trim(x)), lambda x: x <> '')), '|')"


@query(f"SELECT document_id, {_LIST.format('personal_data_categories')} AS labels, translate(document_type, '/: ', '___') AS safe, count(*) AS n FROM synthetic_records GROUP BY ALL")
def label_lists(spark, folder):
    """Sorted parts of a label list, and a label as part of a file name."""
    return _records(spark, folder).groupBy("document_id", F.array_join(S.label_list("personal_data_categories"), "|").alias("labels"), S.safe_name("document_type").alias("safe")).agg(F.count(F.lit(1)).alias("n"))


_TITLES = {"invoice": "Rechnung", "contract": "Vertrag", "expense_report": "Spesenabrechnung"}


@query(
    "SELECT scenario_type, language, CASE WHEN language = 'de' AND scenario_type IN ("
    + ", ".join(f"'{k}'" for k in _TITLES)
    + ") THEN CASE scenario_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLES.items())
    + " END ELSE array_to_string(list_transform(string_split(replace(scenario_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title, count(*) AS n FROM synthetic_records GROUP BY ALL"
)
def titles(spark, folder):
    """Headings of scenarios, in German where there is a German name."""
    return _records(spark, folder).groupBy("scenario_type", "language", S.field_title("scenario_type", "language", _TITLES).alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT scenario_seed, row_seed, 42 + scenario_seed * 1000 AS a, scenario_seed * 10000 + row_seed AS b, count(*) AS n FROM manifest GROUP BY ALL")
def seeds(spark, folder):
    df = table(spark, folder, "manifest")
    return df.groupBy("scenario_seed", "row_seed", S.seed_of("scenario_seed").alias("a"), S.seed_of("scenario_seed", "row_seed").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, CAST(round(score * 1000) AS INT) AS score, count(*) AS n FROM (SELECT unnest(map_keys(per_type_conf)) AS label, unnest(map_values(per_type_conf)) AS score FROM false_negatives) GROUP BY ALL")
def parsed_scores(spark, folder):
    """Maps of scores written as JSON, and in the single-quoted form, and read again."""
    text = F.to_json("per_type_conf")
    text = F.when(F.length(F.coalesce("full_text", F.lit(""))) % 2 == 0, F.replace(text, F.lit('"'), F.lit("'"))).otherwise(text)
    df = _missed(spark, folder).select(F.explode(S.parse_scores(text)).alias("label", "score"))
    return df.groupBy("label", F.round(F.col("score") * 1000).cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, CASE WHEN file_name IS NULL THEN printf('DOC-%04d', row_number() OVER (ORDER BY document_id)) ELSE 'F' END AS id FROM (SELECT document_id, min(file_name) AS file_name FROM synthetic_records WHERE document_id IS NOT NULL GROUP BY document_id)")
def upgrade_ids(spark, folder):
    """Blank ids become numbers by the row's place."""
    df = _records(spark, folder).where("document_id is not null").groupBy("document_id").agg(F.min("file_name").alias("f")).select(F.when(F.col("f").isNull(), F.lit(" ")).otherwise("F").alias("id"), "document_id")
    return upgrade.with_ids(df, "id", F.col("document_id"))


@query("SELECT coalesce(trim(v), '') AS version, n FROM (SELECT CASE WHEN count(DISTINCT trim(dataset_version)) FILTER (trim(dataset_version) <> '') = 1 THEN max(trim(dataset_version)) ELSE 'several' END AS v, count(*) AS n FROM synthetic_records)")
def dataset_version(spark, folder):
    df = _records(spark, folder)
    try:
        found = decide.dataset_version(df)
    except ValueError:
        found = "several"
    return df.agg(F.lit(found).alias("version"), F.count(F.lit(1)).alias("n")).select("version", "n")


# Labels, audits and gaps -----------------------------------------------------------------------------------------------

_SUPPORT = " UNION ALL ".join(f"SELECT '{x}' AS entity, lower(trim(recommended_split)) AS split FROM synthetic_records WHERE {_TRUE.format(f'{x}_yes_no')}" for x in S.ENTITY_LABELS)
_GOALS = ", ".join(f"('{x}', '{s}', {audit.PRIORITY_TARGETS[s] if x in audit.PRIORITY else audit.LEAST_EXAMPLES})" for x in S.ENTITY_LABELS for s in splits.SPLITS)


@query(
    f"""WITH c AS (SELECT entity, split, count(*) AS positives FROM ({_SUPPORT}) GROUP BY ALL), g AS (SELECT * FROM (VALUES {_GOALS}) v(entity, split, target))
    SELECT entity, split, target, coalesce(positives, 0) AS positives, CASE WHEN coalesce(positives, 0) = 0 THEN 'zero' WHEN positives < target THEN 'below' ELSE 'ok' END AS state FROM g LEFT JOIN c USING (entity, split)"""
)
def audit_label_support(spark, folder):
    """Positives of every label and split against their targets, with those that have none."""
    return audit.label_support(_records(spark, folder), "recommended_split")


@query(
    """SELECT category AS scenario_type, l.language FROM (SELECT DISTINCT category FROM sample_targets WHERE field = 'scenario'), (SELECT unnest(['en', 'de', 'fr', 'xx']) AS language) l
    EXCEPT SELECT scenario_type, language FROM synthetic_records"""
)
def audit_missing_cells(spark, folder):
    names = [r[0] for r in table(spark, folder, "sample_targets").where("field = 'scenario'").select("category").distinct().collect()]  # targets are parameters
    return audit.missing_cells(_records(spark, folder), "scenario_type", "language", names, ["en", "de", "fr", "xx"])


@query(
    f"""WITH c AS (SELECT run_id, entity, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT run_id, '{x}' AS entity FROM false_negatives WHERE {_TRUE.format(f'{x}_yes_no')}" for x in S.ENTITY_LABELS)}) GROUP BY ALL)
    SELECT r.run_id, e.entity, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT run_id FROM c) r CROSS JOIN (SELECT unnest({list(S.ENTITY_LABELS)}) AS entity) e LEFT JOIN c ON c.run_id = r.run_id AND c.entity = e.entity"""
)
def entities_by_run(spark, folder):
    """Positives of every label in every run, 0 where a run has none."""
    long = _missed(spark, folder).select("run_id", F.explode(S.active_labels()).alias("entity")).groupBy("run_id", "entity").agg(F.count(F.lit(1)).alias("n")).where("run_id is not null")
    return compare.zero_filled(long, ["run_id"], "entity", S.ENTITY_LABELS, ["n"])


_GAP_F1 = "2 * tp / nullif(2 * tp + fp + fn, 0)"


@query(
    f"""WITH s AS (SELECT lower(trim(recommended_split)) AS split, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (truth AND NOT pred AND NOT routed) AS lost, count(*) FILTER (truth) AS pos
      FROM (SELECT *, detected OR p > 0.7 AS pred, NOT detected AND p BETWEEN 0.3 AND 0.7 AS routed FROM (SELECT recommended_split, {_TRUTH} AS truth, coalesce(contains(full_text, '@'), false) AS detected, (length(coalesce(full_text, '')) * 7919 % 1000) / 1000.0 AS p FROM synthetic_records)) WHERE lower(trim(recommended_split)) IN ('train', 'validation', 'test') GROUP BY ALL),
    m AS (SELECT split, round({_GAP_F1}, 6) AS f1, 1 - lost / pos AS r FROM s),
    w AS (SELECT max(f1) FILTER (split = 'train') AS a, max(f1) FILTER (split = 'validation') AS b, max(f1) FILTER (split = 'test') AS c, max(r) FILTER (split = 'train') AS x, max(r) FILTER (split = 'validation') AS y, max(r) FILTER (split = 'test') AS z, min(f1) AS least_f1 FROM m),
    g AS (SELECT round(a - b, 6) AS train_minus_val_f1, round(b - c, 6) AS val_minus_test_f1, round(x - y, 6) AS train_minus_val_prefilter_recall, round(y - z, 6) AS val_minus_test_prefilter_recall, least_f1 FROM w)
    SELECT *, array_to_string(list_filter([CASE WHEN train_minus_val_f1 >= 0.05 THEN 'train_val_overfit' END, CASE WHEN val_minus_test_f1 >= 0.05 OR val_minus_test_prefilter_recall >= 0.05 THEN 'val_test_calibration_gap' END,
      CASE WHEN abs(train_minus_val_f1) < 0.05 AND abs(val_minus_test_f1) < 0.05 AND least_f1 >= 0.99 THEN 'dataset_too_easy' END], lambda f: f IS NOT NULL), '|') AS flags FROM g"""
)
def split_gaps(spark, folder):
    """Gaps of the stand-in prediction between splits, and what they say."""
    df = _scored(spark, folder).withColumn("split", F.lower(F.trim("recommended_split"))).where(F.col("split").isin(*splits.SPLITS))
    lost = (1 - F.count_if(F.col("truth") & ~F.col("predicted_pii") & ~F.col("needs_llm_review")) / F.count_if("truth")).alias("prefilter_recall")
    scores = metrics.binary(df, F.col("truth"), F.col("predicted_pii"), ("split",), 6).join(df.groupBy("split").agg(lost), "split")
    return splits.read_gaps(splits.gaps(scores, ["f1", "prefilter_recall"]), scores).withColumn("flags", F.array_join("flags", "|"))


@query(
    f"""SELECT *, row_number() OVER (ORDER BY f1 DESC, recall DESC, precision DESC, strategy) AS place FROM (SELECT strategy, n, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1
    FROM (SELECT strategy, count(*) AS n, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn FROM (SELECT strategy, {_TRUTH} AS truth, length(coalesce(full_text, '')) % (2 + length(strategy)) > 0 AS pred FROM false_negatives WHERE strategy IS NOT NULL) GROUP BY strategy))"""
)
def benchmark_ranking(spark, folder):
    """Outputs ranked by their standard prediction (a stand-in that differs by strategy)."""
    from pyspark.sql import Window

    df = _missed(spark, folder).where("strategy is not null").select("strategy", "contains_personal_data", (F.length(F.coalesce("full_text", F.lit(""))) % (2 + F.length("strategy")) > 0).alias("predicted_pii"))
    rows = metrics.stage_metrics(df, ("strategy",)).withColumn("metric_group", F.lit("document")).withColumnRenamed("stage", "metric_name")
    best = Window.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "strategy")
    return metrics.benchmark(rows).select("strategy", "n", "recall", "precision", "f1").withColumn("place", F.row_number().over(best))


@query("SELECT column0 AS \"column\", value, n, CAST(row_number() OVER (PARTITION BY column0 ORDER BY n DESC, value) AS INT) AS place FROM (SELECT 'language' AS column0, language AS value, count(*) AS n FROM synthetic_records WHERE language IS NOT NULL GROUP BY language)")
def sorted_slices(spark, folder):
    """Slices, most frequent first, ties by value."""
    from pyspark.sql import Window

    rows = splits.crosstab(_records(spark, folder), "language", S.norm_bool("contains_personal_data")).withColumnRenamed("language", "value")
    return rows.select(F.lit("language").alias("column"), "value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("place"))


# Decisions, registries and comparisons -----------------------------------------------------------------------------

_ZONE = "CASE WHEN NOT coalesce(needs_bert_review, false) THEN '' WHEN pii_probability < 0.1 THEN 'confident_non_pii' WHEN pii_probability > 0.25 THEN 'confident_pii' ELSE 'routed_to_llm' END"


@query(
    f"""SELECT strategy, prediction_source, count(*) AS n, count(*) FILTER (pred) AS positive FROM (
    SELECT unnest(['plain', 'asked', 'scored', 'both']) AS strategy, unnest(['rules', 'rules+llm', 'rules+score', 'rules+score+llm']) AS prediction_source,
      unnest([d, d OR l, d OR (b AND coalesce(pii_probability, 0) >= 0.2), d OR (b AND z = 'confident_pii') OR (b AND z = 'routed_to_llm' AND l)]) AS pred
    FROM (SELECT coalesce(detected_pii, false) AS d, coalesce(bert_pii, false) AS l, coalesce(needs_bert_review, false) AS b, pii_probability, {_ZONE} AS z FROM false_negatives)) GROUP BY ALL"""
)
def registry_dispatch(spark, folder):
    """Strategies from settings, run through their runners over one scored table (the scorer stands for the reviewer)."""
    chosen = decide.registered({"plain": {"runner": "rules"}, " Asked ": {"runner": "llm", "llm": "STUB"}, "scored": {"runner": "score", "scorer": "linear"}, "both": {"runner": "hybrid", "scorer": "linear", "llm": "stub"}})
    df = _missed(spark, folder).withColumn("llm_pii", F.col("bert_pii")).withColumn("routing_zone", decide.zone("pii_probability", 0.1, 0.25, F.col("needs_bert_review")))
    df = df.withColumn("routed_to_llm", F.col("routing_zone") == decide.ZONES[1])
    out = decide.run_strategies(df, decide.strategies(["PLAIN", "asked", "scored", "both "], chosen), "r", 0.2)
    return out.groupBy("strategy", "prediction_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("predicted_pii").alias("positive"))


@query(
    """SELECT label, CAST(round(score * 10000) AS INT) AS score, count(*) AS n FROM (SELECT unnest(['PERSON', 'EMAIL_ADDRESS', 'URL']) AS label, unnest([x, x / 2, 1 - x]) AS score FROM (SELECT CAST(length(coalesce(full_text, '')) % 97 AS DOUBLE) / 97 AS x FROM synthetic_records))
    WHERE score >= CASE label WHEN 'PERSON' THEN 0.7 WHEN 'URL' THEN 0.3 ELSE 0.5 END GROUP BY ALL"""
)
def predicted_labels(spark, folder):
    """Labels whose score reaches their own threshold, or the default."""
    x = (F.length(F.coalesce("full_text", F.lit(""))) % 97).cast("double") / 97
    scores = F.create_map(F.lit("PERSON"), x, F.lit("EMAIL_ADDRESS"), x / 2, F.lit("URL"), 1 - x)
    got = _records(spark, folder).select(F.explode(decide.predicted_labels(scores, {"PERSON": 0.7, "URL": 0.3})).alias("label", "score"))
    return got.groupBy("label", F.round(F.col("score") * 10000).cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT coalesce(run_id, '') AS run, array_to_string(list_filter([CASE WHEN strategy IS NOT NULL THEN 'strategy=' || strategy END, CASE WHEN provider IS NOT NULL THEN 'provider=' || provider END, CASE WHEN model_name IS NOT NULL THEN 'model_name=' || model_name END], lambda x: x IS NOT NULL), '|') AS params,
    CASE WHEN pii_probability IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN inference_ms IS NOT NULL THEN 1 ELSE 0 END AS metrics, count(*) AS n FROM false_negatives GROUP BY ALL"""
)
def tracked_rows(spark, folder):
    """Parameters and numbers of each row as a tracker takes them; absent fields, nulls and text are left out."""
    df = compare.tracked(_missed(spark, folder), ["strategy", "provider", "no_such_field", "model_name"], ["pii_probability", "inference_ms", "route"])
    params = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return df.groupBy("run", params.alias("params"), F.size("metrics").alias("metrics")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT document_id, strategy, run_id, count(*) AS n FROM (SELECT document_id, 'sweep1' AS strategy, 'base' AS run_id FROM synthetic_records WHERE document_id IS NOT NULL) GROUP BY ALL")
def sweep_baseline(spark, folder):
    """The first sweep alone as an output: a row for each row of the dataset, with the decision of the rules."""
    docs = _records(spark, folder).where("document_id is not null")
    swept = fusion.sweep(docs.dropDuplicates(["document_id"]).select("document_id", "full_text"))
    out = compare.sweep_baseline(docs, swept, "base", 1.23456)
    wrong = F.count_if((F.col("predicted_pii") != F.col("detected_pii")) | (F.col("inference_ms") != 1.2346))
    return out.groupBy("document_id", "strategy", "run_id").agg(F.count(F.lit(1)).alias("n"), wrong.alias("_w")).where("_w = 0").drop("_w")


@query("SELECT coalesce(run_id, 'unnamed') AS run, count(*) AS n, count(*) FILTER (provider IS NOT NULL) AS providers FROM false_negatives GROUP BY ALL")
def io_tracked(spark, folder):
    """Rows for a tracker saved by run and read again."""
    path = _folder(spark)
    compare.write_tracked(compare.tracked(_missed(spark, folder), ["strategy", "provider"], ["pii_probability"]), path)
    df = spark.read.schema("params map<string,string>, metrics map<string,double>, run string").json(path)
    return df.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.map_contains_key("params", "provider")).alias("providers"))


@query(
    f"""SELECT strategy, routing_zone, detected_pii OR routing_zone IN ('confident_pii', 'routed_to_llm') AS predicted_pii, count(*) AS n, {len(decide.CONTRACT)} AS columns FROM (SELECT strategy, coalesce(detected_pii, false) AS detected_pii, {_ZONE} AS routing_zone FROM false_negatives) GROUP BY ALL"""
)
def output_contract(spark, folder):
    """Scored outputs of each strategy in their fixed columns; routed rows count as predicted."""
    df = _missed(spark, folder).withColumn("routing_zone", decide.zone("pii_probability", 0.1, 0.25, F.col("needs_bert_review")))
    df = df.withColumn("routed_to_llm", F.col("routing_zone") == decide.ZONES[1])
    out = None
    for r in df.select("strategy").distinct().collect():  # strategies are a few
        one = decide.output_frame(df.where(F.col("strategy").eqNullSafe(r["strategy"])))
        one = one.withColumns({"strategy": F.lit(r["strategy"]), "columns": F.lit(len(one.columns))})
        out = one if out is None else out.unionByName(one)
    return out.groupBy("strategy", "routing_zone", "predicted_pii", "columns").agg(F.count(F.lit(1)).alias("n"))


_RUNS = (
    ("a", ("m1", 256), (0.2, 0.99, 1, 0.1, 0.8), ("stratified", 3, 12.5, 4.0, (("train", 70), ("test", 15)), (0.9, 0.8, 0.7, 0.75, 0.85))),
    ("b", ("m2", None), (0.3, None, 2, 0.2, 0.9), ("recommended", None, None, None, None, (None, None, None, None, None))),
)


@query("SELECT * FROM (VALUES ('a', 'm1', 'stratified', 256, 0.75, 0.2, 85), ('b', 'm2', 'recommended', NULL, NULL, 0.3, 0)) v(run, model, split_mode, max_length, val_f1, routed_fraction, documents)")
def run_comparison(spark, folder):
    """Runs side by side; what a run doesn't say is null."""
    return compare.comparison(spark.createDataFrame(list(_RUNS), compare.SUMMARY_DDL)).select("run", "model", "split_mode", "max_length", "val_f1", "routed_fraction", "documents")


# Plans and generated records ----------------------------------------------------------------------------------------


@query(
    """SELECT value, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'N (m@x)' WHEN 1 THEN 'N, 030' WHEN 2 THEN 'N; IBAN: DE1' WHEN 3 THEN 'DE1' ELSE '030; DE1' END AS value FROM (SELECT length(coalesce(full_text, '')) % 5 AS k FROM synthetic_records)) GROUP BY value"""
)
def paired_values(spark, folder):
    """Values of one field as one text, in every combination that has a form of its own."""
    k = F.length(F.coalesce("full_text", F.lit(""))) % 5
    m = lambda *x: F.create_map(*map(F.lit, x))
    values = F.when(k == 0, m("PERSON", "N", "EMAIL_ADDRESS", "m@x")).when(k == 1, m("PHONE_NUMBER", "030", "PERSON", "N")).when(k == 2, m("PERSON", "N", "IBAN_CODE", "DE1")).when(k == 3, m("IBAN_CODE", "DE1")).otherwise(m("PHONE_NUMBER", "030", "IBAN_CODE", "DE1"))
    return _records(spark, folder).select(planner.paired(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT g AS generator, v AS prompt_version, count(*) AS n FROM (SELECT
      CASE WHEN NOT r THEN 'faker_archetype_v1' WHEN scenario_type = 'contract' AND coalesce(variant, '') <> 'blank' THEN CASE WHEN ok THEN 'openrouter_gpt4o_mini_field' ELSE 'faker_archetype_fallback' END WHEN scenario_type = 'invoice' THEN CASE WHEN ok THEN 'openrouter_gpt4o_mini_document' ELSE 'faker_archetype_fallback' END ELSE 'faker_archetype_v1' END AS g,
      CASE WHEN NOT r THEN 'template_v1' WHEN scenario_type = 'contract' AND coalesce(variant, '') <> 'blank' THEN 'field_llm_v1' || CASE WHEN ok THEN '' ELSE '_fallback' END WHEN scenario_type = 'invoice' THEN 'llm_rewrite_v1' || CASE WHEN ok THEN '' ELSE '_fallback' END ELSE 'template_v1' END AS v
      FROM (SELECT scenario_type, variant, coalesce(row_seed, 0) % 3 > 0 AS r, coalesce(row_seed, 0) % 2 = 0 AS ok FROM manifest)) GROUP BY ALL"""
)
def made_by(spark, folder):
    """What records say about how they were made."""
    seed = F.coalesce("row_seed", F.lit(0))
    m = planner.generation_metadata(F.col("scenario_type"), F.col("variant"), seed % 3 > 0, seed % 2 == 0, ["contract"], ["invoice"])
    return table(spark, folder, "manifest").select(m.alias("m")).groupBy("m.generator", "m.prompt_version").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT document_id, CASE WHEN k = 0 OR k = 3 THEN 'A ' || document_id || ' x' || chr(10) || 'ref 77' ELSE 'A ' || document_id || ' x ref 77' END AS text, k <> 3 AS asked, k NOT IN (0, 3) AS succeeded, count(*) AS n
    FROM (SELECT document_id, length(coalesce(full_text, '')) % 4 AS k FROM synthetic_records WHERE document_id IS NOT NULL) GROUP BY ALL"""
)
def rewritten_documents(spark, folder):
    """Documents in a model's words where it keeps the values it must; others, and those not asked for, as they were."""
    k = F.length(F.coalesce("full_text", F.lit(""))) % 4
    docs = _records(spark, folder).where("document_id is not null").select("document_id", F.concat(F.lit("A "), "document_id", F.lit(" x\nref 77")).alias("t"), F.when(k == 0, F.array(F.lit("gone"))).otherwise(F.array("document_id", F.lit("77"))).alias("need"), (k != 3).alias("flag"))
    got = rewrite.rewritten(docs, "document_id", "t", "need", "flag", "stub")
    return got.groupBy(F.col("id").alias("document_id"), "text", "asked", "succeeded").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT category, CAST(target_share AS VARCHAR) AS share, count(*) AS n FROM sample_targets GROUP BY ALL")
def io_sheet(spark, folder):
    """A table of targets as a spreadsheet, read again."""
    rows = table(spark, folder, "sample_targets").select("category", F.col("target_share").cast("string").alias("share")).collect()  # 21 rows by definition
    data = sheets.write_sheet([["category", "share"], *[[r["category"], r["share"]] for r in rows]])
    path = _folder(spark)
    runs.write_bytes(spark, data, f"{path}/targets.xlsx")
    return sheets.read_sheets(spark, path, ["category", "share"]).groupBy("category", "share").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, true AS ordered, CAST(count(*) AS BIGINT) AS n FROM synthetic_records WHERE file_created_date IS NOT NULL GROUP BY document_id")
def passport_order(spark, folder):
    """Dates of birth, issue and expiry in order, whichever of them is fixed: adults, and ten years of 365 days."""
    day, seed = F.col("file_created_date"), F.xxhash64("document_id")
    ok = F.lit(True)
    for fixed in ("date_of_birth", "issue_date", "expiry_date"):
        d = planner.passport_dates(day, day, day, fixed, seed)
        ok = ok & (d[fixed] == day) & (F.datediff(d["issue_date"], d["date_of_birth"]) >= 18 * 365) & (F.datediff(d["expiry_date"], d["issue_date"]) == 3650)
    return _records(spark, folder).where("file_created_date is not null").groupBy("document_id").agg(F.bool_and(ok).alias("ordered"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
