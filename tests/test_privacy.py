"""Privacy operators against Python's regular expressions, plain restatements and SQL."""

import datetime
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.operators import audit, decide, detect, errors, fusion, metrics, planner, recognise, review, splits, thresholds, upgrade
from veilspark.sources import runs
from veilspark.streaming import sweep as streaming

FOLDER = "/root/testdata/sf0.001"

TEXTS = [
    "mail a.b@host.de, Ä.ö@x-y.org; https://a.test/x?y=1.", "DE44500105175407324931 and 4111 1111 1111 1111 and P12345678 üP12345678", "Medical ID 12, FRANZÖSISCH, Dutch Danish", "+1-805-872-3511x96849. 0049 30 1234567",
    "1234567890123456789012345", "03-01-2025 and 030 12345678", "DE12 3456 0301234567890", None, "", "  ", "a@b.cd" * 3, "tel (0) 30 1234-567 ext. 22", "192.168.0.1 P99999999 p99999999",
]


def python_spans(text, kind):
    pattern = re.sub(r"^\(\?([a-zA-Z]+)\)", lambda m: "(?i)" if "i" in m.group(1) else "", detect.PATTERNS[kind])
    return [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, text)] if text and text.strip() else []


@pytest.mark.parametrize("kind", list(detect.PATTERNS))
def test_spans_equal_python(spark, kind):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for r in df.select("t", detect.spans("t", detect.PATTERNS[kind], kind).alias("s")).collect():
        assert [(s["value"], s["start"], s["end"]) for s in r["s"]] == python_spans(r["t"], kind)


def test_phones(spark):
    rows = {r["t"]: [s["value"] for s in r["p"] if s["type"] == "PHONE_NUMBER"] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", detect.pattern_spans("t").alias("p")).collect()}
    assert rows[TEXTS[3]][0] == "+1-805-872-3511x96849" and rows[TEXTS[4]] == [] and "03-01-2025" not in rows[TEXTS[5]]


def span(kind, start, end, source="ner", conf=0.5):
    return {"type": kind, "value": "x", "confidence": conf, "source": source, "start": start, "end": end}


def test_fusion_and_routes(spark):
    rows = [
        (1, [span("EMAIL_ADDRESS", 0, 5, "custom_regex", 0.9)], [span("EMAIL_ADDRESS", 0, 5), span("LOCATION", 10, 20)]),
        (2, [], [span("LOCATION", 10, 20), span("DATE_TIME", 60, 70), span("DATE_TIME", 300, 310)]), (3, [], [span("DATE_TIME", 60, 70)]), (4, [], []),
    ]
    df = spark.createDataFrame(rows, f"id int, p {detect.SPANS}, n {detect.SPANS}")
    got = {r["id"]: r for r in fusion.route(fusion.fuse(df, "p", "n")).collect()}
    assert got[1]["per_type_conf"]["EMAIL_ADDRESS"] == 1.0 and got[1]["route"] == "local_pii" and got[1]["strong_pii_categories"] == ["EMAIL_ADDRESS"]
    assert got[2]["potential_pii_categories"] == ["LOCATION", "DATE_TIME"] and len(got[2]["entities"]) == 2 and got[2]["needs_llm_review"]
    assert got[3]["route"] == got[4]["route"] == "local_non_pii" and got[4]["per_type_conf"] == {}


def test_recogniser_filters(spark):
    text = "Ms Anna Berg, REF-4324364, Tel: 1234567"
    report = [span("PERSON", 3, 12, conf=0.85) | {"value": "Anna Berg"}, span("PERSON", 0, 4) | {"value": "Anna"}, span("LOCATION", 0, 2) | {"value": "IT-7"}, span("LOCATION", 0, 2) | {"value": "Q3"}, span("LOCATION", 0, 2) | {"value": "Prof. X"}, span("LOCATION", 0, 2) | {"value": "Berlin"}, span("PHONE_NUMBER", 18, 25) | {"value": "4324364"}, span("PHONE_NUMBER", 32, 39) | {"value": "1234567"}, span("AGE", 0, 2), span("URL", 0, 2, conf=0.4)]
    got = spark.createDataFrame([(text, report)], f"t string, n {detect.SPANS}").select(recognise.kept(F.col("n"), F.col("t")).alias("k")).first()["k"]
    assert [(s["type"], s["value"]) for s in got] == [("PERSON", "Anna Berg"), ("LOCATION", "Berlin"), ("PHONE_NUMBER", "1234567")]


def test_context_windows(spark):
    text = "x" * 1000
    rows = [(text, [span("A", 300, 310), span("B", 650, 660), span("C", 100, 110)]), (text, []), (None, []), ("  ", []), (text, [span("A", None, None)])]
    got = spark.createDataFrame(rows, f"t string, e {detect.SPANS}").select(review.windows("t", "e").alias("w"), review.review_text("t", "e").alias("r")).collect()
    assert [(w["start"], w["end"]) for w in got[0]["w"]] == [(0, 860)] and len(got[0]["r"]) == 860
    assert got[1]["r"] == text and got[2]["r"] == got[3]["r"] == "" and got[4]["r"] == text


def test_answers(spark):
    rows = ['{"contains_pii": true, "reason": "r"}', 'So: {"contains_pii": "TRUE"} ok', '{"contains_pii": , "reason": "y"}', "none", '{"contains_pii": tru', None, '{"contains_pii": 1}', '{"contains_pii": "yes"}']
    got = [r["a"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(review.read_answer("x").alias("a")).collect()]
    assert [(g["contains_pii"], g["success"]) for g in got] == [(True, True), (True, True), (False, True), (False, False), (False, False), (False, False), (True, True), (False, True)]


def test_reviews_touch_flagged_rows_only_and_survive_errors(spark):
    def broken(prompt, model):
        if "bad" in prompt:
            raise ValueError("no")
        return {"content": '{"contains_pii": true}'}

    df = spark.createDataFrame([(1, "ok a", True), (2, "bad", True), (3, "ok", False), (4, None, True)], "id int, t string, f boolean").withColumn("e", F.array().cast(detect.SPANS))
    got = {r["id"]: r for r in review.run_reviews(df, "id", "t", "e", "f", "m", provider=broken).collect()}
    assert set(got) == {1, 2} and got[1]["llm_pii"] and not got[2]["llm_request_success"]
    calls = []

    def flaky(prompt, model):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return {"content": "x"}

    assert review.with_retries(flaky, wait=lambda s: None)("p", "m")["content"] == "x" and len(calls) == 3


def test_decisions(spark):
    rows = [(True, None, None, False), (False, 0.95, False, False), (False, 0.02, False, False), (False, 0.5, True, True), (False, 0.5, True, False), (None, float("nan"), None, None), (False, 0.3, None, None), (False, 0.7, None, None)]
    df = spark.createDataFrame(rows, "detected_pii boolean, pii_probability double, routed_to_llm boolean, llm_pii boolean").withColumn("needs_bert_review", F.col("pii_probability").isNotNull())
    df = df.withColumn("routing_zone", decide.zone("pii_probability", 0.3, 0.7, F.col("needs_bert_review")))
    got = df.select("routing_zone", decide.by_score(0.5).alias("s"), decide.by_zones().alias("z"), decide.by_llm().alias("l")).collect()
    assert [r["routing_zone"] for r in got] == ["", "confident_pii", "confident_non_pii", *["routed_to_llm"] * 5]
    assert [r["s"] for r in got] == [True, True, False, True, True, False, False, True] and [r["z"] for r in got] == [True, True, False, True, False, False, False, False]
    with pytest.raises(ValueError):
        decide.strategies(["nope"])
    assert decide.strategies([" Hybrid "])[0].runner == "hybrid"


def test_metrics_and_errors(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["yes", "no", "YES", None]), rnd.random() < 0.5, rnd.choice(["en", "de", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "contains_personal_data string, predicted_pii boolean, language string")
    truth = [str(a).lower() == "yes" for a, _, _ in rows]
    tp = sum(t and p for t, (_, p, _) in zip(truth, rows))
    m = metrics.stage_metrics(df).first()
    assert m["n"] == 200 == m["TP"] + m["TN"] + m["FP"] + m["FN"] and m["TP"] == tp and m["precision"] == round(tp / sum(p for _, p, _ in rows), 4)
    assert metrics.stage_metrics(df.limit(0)).count() == 0
    typed = errors.typed(df)
    assert sum(r["count"] for r in errors.summary(typed).collect()) == 200
    by = errors.grouped(typed, {"a": ("language",), "b": ("absent",)}).collect()
    assert {r["summary"] for r in by} == {"a"} and sum(r["count"] for r in by) == sum(lang is not None for *_, lang in rows)


def test_thresholds_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(round(rnd.random() * 0.6 + 0.4 * (i % 3 == 0), 2), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, True), (float("nan"), False)], "p double, y boolean")
    cands = {r["t"] for r in thresholds.candidates(thresholds.scored(df, "p", F.col("y")), 11).collect()}
    ps = sorted({p for p, _ in rows})
    assert {round(c, 9) for c in cands} == {round(c, 9) for c in {i / 10 for i in range(11)} | set(ps) | {(a + b) / 2 for a, b in zip(ps, ps[1:])}}
    n, pos, best, feasible = len(rows), sum(y for _, y in rows), None, 0
    for low in sorted(cands):
        missed = sum(y and p < low for p, y in rows)
        if 1 - missed / pos < 0.9:
            continue
        for high in sorted(c for c in cands if c >= low):
            yes = [y for p, y in rows if p > high]
            if yes and round(sum(yes) / len(yes), 6) < 0.8:
                continue
            feasible += 1
            no = sum(p < low for p, _ in rows)
            key = (round((n - no - len(yes)) / n, 6), missed, len(yes) - sum(yes), -no, low, high)
            best = min(best or key, key)
    got = thresholds.calibrate(df, "p", F.col("y"), 0.9, 0.8, 11).first()
    assert (got["routed_fraction"], got["missed"], got["t_low"], got["t_high"]) == (best[0], best[1], best[4], best[5]) and got["n_feasible_points"] == feasible
    hopeless = thresholds.frontier(df, "p", F.col("y"), [1.0], 1.01, 11).first()
    assert hopeless["feasible"]  # an empty upper zone violates no precision
    with pytest.raises(ValueError):
        thresholds.calibrate(df.where("not y"), "p", F.col("y"), 0.9, 0.8)
    ranked = sorted(rows, key=lambda r: (-r[0], r[1]))
    ap, tp = 0.0, 0
    for k, (_, y) in enumerate(ranked, 1):
        tp += y
        ap += tp / k if y else 0
    assert abs(thresholds.average_precision(df, "p", F.col("y"), "y").first()["average_precision"] - ap / pos) < 1e-9


def _best_points(scores, n, pos, recalls, precision, steps):
    """Of all pairs of candidates, from counts by score: key of the best one and number of feasible ones."""
    n_all, n_pos = n.sum(), pos.sum()
    cands = np.unique(np.concatenate([np.arange(steps) / (steps - 1), scores, (scores[1:] + scores[:-1]) / 2]))
    cn, cp = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(pos))
    below, upto = np.searchsorted(scores, cands, "left"), np.searchsorted(scores, cands, "right")
    yes, tp = n_all - cn[upto], n_pos - cp[upto]
    fits = (yes == 0) | (np.round(tp / np.maximum(yes, 1), 6) >= precision)
    out = {}
    for r in recalls:
        best, feasible = None, 0
        for i in np.flatnonzero(1 - cp[below] / n_pos >= r):
            js = np.flatnonzero(fits[i:]) + i
            feasible += len(js)
            part = np.floor((n_all - cn[below[i]] - yes[js]) / n_all * 1e6 + 0.5) / 1e6
            js = js[part == part.min()]
            j = min(js.tolist(), key=lambda j: (yes[j] - tp[j], cands[j]))
            key = (round(float(part.min()), 6), int(cp[below[i]]), int(yes[j] - tp[j]), -int(cn[below[i]]), float(cands[i]), float(cands[j]))
            best = min(best or key, key)
        out[r] = (*best[:3], *best[4:], feasible)
    return out


@pytest.mark.parametrize("rows, values, recalls", [(20_500, 1_000_003, [0.997, 0.999]), (4_000_000, 150, [0.8, 0.95, 1.0])])
def test_frontier_of_many_scores_and_rows_equals_all_pairs(spark, rows, values, recalls):
    score = F.pow(F.pmod(F.col("id") * 7919, F.lit(values)) / values, F.lit(3)) if values < 1000 else F.pmod(F.col("id") * 7919, F.lit(values)) / values
    df = spark.range(rows).select(F.round(score, 6).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < F.floor(score * 800) + 60).alias("y"))
    by = df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")).orderBy("p").toPandas()
    want = _best_points(by["p"].to_numpy(), by["n"].to_numpy(), by["pos"].to_numpy(), recalls, 0.6, 11)
    got = {r["recall_target"]: (r["routed_fraction"], r["missed"], r["auto_yes_fp"], r["t_low"], r["t_high"], r["n_feasible_points"]) for r in thresholds.frontier(df, "p", F.col("y"), recalls, 0.6, 11).collect()}
    assert got == want


def test_split_keeps_groups_and_shares(spark):
    rows = [(f"Text  {i % 140}", i % 7 == 0) for i in range(200)] + [(None, False), ("text 3", True)]
    df = spark.createDataFrame(rows, "t string, y boolean")
    got = splits.stratified_split(df, "t", F.col("y"))
    assert got.count() == got.select("key").distinct().count() == 141
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(n["train"] - 0.7 * 141) <= 3 and abs(n["test"] - 0.15 * 141) <= 3
    assert splits.with_split(df, "t", got).groupBy(S.text_key("t").alias("k")).agg(F.count_distinct("assigned_split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        splits.stratified_split(df, "t", F.col("y"), 0.6, 0.5)


def test_planner(spark):
    assert planner.allocate(10, {"a": 0.35, "b": 0.35, "c": 0.3}) == {"a": 4, "b": 3, "c": 3}
    combos = {"s": [["PERSON"], ["PERSON", "URL"]], "t": [["URL"]]}
    plan = [r for i, s in enumerate(combos) for r in planner.scenario_plan(s, i, 100, combos[s], ["filled", "blank"])]
    more, short = planner.top_up(plan, combos, {"URL": {"test": 5}, "NRP": {"test": 1}})
    assert len(more) == 200 and short == ["NRP/test: got 0 of 1"] and sum("URL" in r["entity_types"] and r["recommended_split"] == "test" for r in more) >= 5
    table = planner.plan_table(spark, more)
    assert all(r["count"] == 0 for r in planner.plan_violations(table).collect())
    docs = planner.documents(table, S.ENTITY_LABELS)
    assert docs.where("full_text is null").count() == 0 and docs.select("row_seed").distinct().count() == 200
    for fixed in ("date_of_birth", "issue_date", "expiry_date"):
        day = F.lit(datetime.date(2015, 5, 1))
        r = spark.range(20).select(*[c.alias(k) for k, c in planner.passport_dates(day, day, day, fixed, F.col("id")).items()]).collect()
        assert all(x["date_of_birth"] < x["issue_date"] < x["expiry_date"] and x[fixed] == datetime.date(2015, 5, 1) for x in r)


def test_audit_and_upgrade(spark):
    flags = ", ".join(f"{x}_yes_no string" for x in S.ENTITY_LABELS)
    no = ("no",) * 11
    rows = [("a", "text x@y.example", "no", "no", *no), ("a", "text", "yes", "yes", *no), ("b", "text", "yes", "no", *no), (None, None, None, None, *no)]
    df = spark.createDataFrame([(*r, "en", "invoice", "train", "PERSON", 1, 1, "PERSON") for r in rows], f"document_id string, full_text string, contains_personal_data string, {flags}, language string, scenario_type string, recommended_split string, primary_pii_type string, category_count int, pii_count int, personal_data_categories string")
    manifest = spark.createDataFrame([("a", "invoice", "blank", "de"), ("c", "x", None, "en")], "document_id string, scenario_type string, variant string, language string")
    got = {r["check"]: r for r in audit.audit(df, manifest, "document_id", "full_text", {"language": ["de"]}, ["full_text"]).collect()}
    assert got["repeated_ids"]["count"] == 1 and got["id_differences"]["count"] == 2 and got["differing_fields"]["count"] == 1 and got["identifiers_in_negatives"]["count"] == 1 and got["positive_without_labels"]["count"] == 1
    assert "FAIL" in audit.render(list(got.values())) and audit.audit(df, manifest, "document_id", "full_text", {}, ["nope"]).first()["level"] == "FAIL"
    up = upgrade.upgraded(spark.createDataFrame([("", "Rechnung", "1"), ("nan", "x", None)], "language string, full_text string, edge_case string"))
    assert [r["language"] for r in up.collect()] == ["de", "en"] and [r["scenario_type"] for r in up.collect()] == ["invoice", "general_document"] and [r["challenge_category"] for r in up.collect()] == ["invoice_number", "none"]
    ids = upgrade.with_ids(spark.createDataFrame([(None, 3), ("", 1), ("K", 2)], "id string, o int"), "id", F.col("o")).orderBy("o").collect()
    assert [r["id"] for r in ids] == ["DOC-0001", "K", "DOC-0003"]


def test_run_storage_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", "mail x@y.de", datetime.datetime(2024, 1, 1))], "document_id string, full_text string, at timestamp")
    root = str(tmp_path / "runs")
    for run in ("20240102_0", "20240103_0"):
        runs.write_output(df, root, run, "sweep1")
    assert runs.latest_run(spark, root) == "20240103_0" and runs.read_outputs(spark, root).count() == 2
    runs.write_json(spark, {"a": 1}, root + "/meta.json")
    assert runs.read_json(spark, root + "/meta.json") == {"a": 1} and runs.read_json(spark, root + "/none.json") == {}
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.document_stream(spark, str(tmp_path / "in"), df.schema)
    streaming.write_swept(streaming.swept(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["route"] == "local_pii"


def test_scalars(spark):
    df = spark.createDataFrame([(" JA ", "1.0", '{"a": 0.5}', "B; a;;"), (None, "x", "bad", None)], "b string, n string, j string, l string")
    got = df.select(S.norm_bool("b").alias("b"), S.safe_int("n").alias("n"), S.parse_scores("j").alias("j"), S.label_list("l").alias("l"), S.safe_divide(F.lit(1), F.lit(0)).alias("d")).collect()
    assert (got[0]["b"], got[0]["n"], got[0]["j"], got[0]["l"]) == (True, 1, {"a": 0.5}, ["B", "a"]) and (got[1]["b"], got[1]["n"], got[1]["j"], got[1]["l"], got[1]["d"]) == (False, None, {}, [], 0.0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    from veilspark.plans import privacy

    con = duckdb.connect()
    for name in ("synthetic_records", "manifest", "false_negatives", "generation_requests", "sample_targets"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name in ("detect_email", "context_windows", "stage_metrics", "error_by_keys", "slice_by_difficulty", "audit_alignment", "largest_remainder"):
        a = privacy.queries()[name](spark, FOLDER).toPandas()
        b = con.execute(privacy.oracle_sql()[name]).df()
        assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b), name


def test_dealing_by_rank_equals_dealing_cards(spark):
    from veilspark.operators import splits

    for shares in ({"train": 0.7, "validation": 0.15, "test": 0.15}, {"train": 0.6181, "validation": 0.2345, "test": 0.1474}, {"train": 1 / 3, "validation": 1 / 3, "test": 1 / 3}):
        counts, want = dict.fromkeys(shares, 0), []
        for _ in range(500):
            s = min((round(counts[s] / f, 9), s) for s, f in shares.items())[1]
            counts[s] += 1
            want.append(s)
        got = [r[0] for r in spark.range(500).select(splits.dealt(F.col("id"), shares)).collect()]
        assert got == want


def test_registries_refuse_what_they_do_not_know():
    from veilspark.operators import decide

    for bad in ({"x": {"runner": "none"}}, {"x": {"runner": "llm"}}, {"x": {"runner": "llm", "llm": "linear"}}, {"x": {"runner": "hybrid", "scorer": "linear", "llm": "gone"}}):
        with pytest.raises(ValueError):
            decide.registered(bad)
    assert decide.registered({" A ": {"runner": "score", "scorer": "LINEAR"}})["a"].prediction_source == "rules+score"
    with pytest.raises(ValueError):
        decide.model("stub", "scorer")


def test_the_scorer_learns_words(spark):
    from veilspark.operators import scorer

    rows = [(f"d{i}", f"invoice {i} of room {i % 7}" + (" born on monday" if i % 3 == 0 else ""), "yes" if i % 3 == 0 else "no") for i in range(300)] + [("n", None, "no"), (None, "x", "yes")]
    df = spark.createDataFrame(rows, "document_id string, full_text string, contains_personal_data string")
    weights = scorer.fit(df, "document_id", "full_text", F.col("contains_personal_data") == "yes")
    p, labels = scorer.linear_scorer(weights)()(["invoice born on monday", "invoice of room 3", None, ""])
    assert p[0] > 0.6 > 0.4 > p[1] and set(labels[0]) >= {"PERSON"} and p[2] == p[3]


def test_offsets_of_many_matches(spark):
    from veilspark.operators import detect

    text = "x" + " ä P12345678" * 400
    got = spark.createDataFrame([(text,), (None,)], "t string").select(detect.spans("t", detect.PATTERNS["PASSPORT"], "PASSPORT").alias("s")).collect()
    assert [text[s["start"] : s["end"]] for s in got[0]["s"]] == ["P12345678"] * 400 and got[1]["s"] == []


def test_clients_tell_what_may_be_tried_again():
    import http.server
    import json
    import threading
    import urllib.error

    from veilspark.operators import clients

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = 503 if body["model"] == "busy" else 400 if body["model"] == "bad" else 200
            out = {"response": "hi", "eval_count": 3} if self.path.endswith("generate") else {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "cost": 0.5}}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    chat = clients.ChatClient(url)
    assert chat("abc", "m") == {"content": "ABC", "prompt_tokens": 5, "completion_tokens": 2, "cost": 0.5}
    assert clients.LocalClient(url)("abc", "m")["content"] == "hi"
    with pytest.raises(ConnectionError):
        chat("abc", "busy")
    with pytest.raises(urllib.error.HTTPError):
        chat("abc", "bad")
    with pytest.raises(ValueError):
        clients.ChatClient(url, "VEILSPARK_NO_SUCH_KEY")("abc", "m")
    waits = []
    assert review.with_retries(chat, (0, 1), waits.append)("abc", "busy")["error"] == "no connection" and waits == [0, 1]
    server.shutdown()
    assert not clients.LocalClient(url).healthy()


def test_logs_turn_over(tmp_path):
    from veilspark import logs

    log = logs.configured(str(tmp_path), most_bytes=400, kept=2)
    for i in range(30):
        log.info("line %d", i)
    assert len(list(tmp_path.iterdir())) == 3
    logs.configured()


def test_searched_texts_are_those_that_may_match(spark):
    cases = {"NRP": ["ein SWISS pass", "a \u017fwiss form", "französisch", "FRANZÖSISCH", "Sw\u0130SS", "swede"], "URL": ["HTTP\u017f://x.y", "see https://a.b/c d", "htt p"], "MEDICAL_LICENSE": ["ARZTNUMMER", "med\u0131cal id", "Medical  ID", "medic"], "EMAIL_ADDRESS": ["A@B.DE", "a at b.de"]}
    for kind, texts in cases.items():
        df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
        plain = F.coalesce(F.regexp_extract_all("t", F.lit(detect.PATTERNS[kind]), F.lit(0)), F.array().cast("array<string>"))
        assert df.where(plain != F.transform(detect.spans("t", detect.PATTERNS[kind], kind), lambda s: s["value"])).count() == 0
