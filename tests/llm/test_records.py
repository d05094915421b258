"""Near-duplicates, split overlaps and quota samples against brute force, and on awkward rows."""

import itertools
import random
import re

import numpy as np
import pytest

from veilspark.llm import neardup, quotasample, splitoverlap

WORD = re.compile(r"[^\W_]+")


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similarity(a, b, k):
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y) if x | y else 0.0


def texts(seed, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            w = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 60))))
    return out


AWKWARD = [(None, "g", "train", "a b c d e f g h"), ("n1", None, None, None), ("n2", "g", "train", ""), ("n3", "g", "test", " \n"), ("n4", "g", "test", "two words"), ("n5", None, "train", "a b c d e f g h i j")]


def table(spark, seed, awkward=True):
    rnd = random.Random(seed)
    rows = [(f"d{i:03}", rnd.choice("gh"), rnd.choice([" Train", "train", "validation", "TEST "]), t) for i, t in enumerate(texts(seed))]
    rows += [rows[0], rows[3], ("copy1", *rows[5][1:]), ("copy2", rows[5][1], "test", rows[5][3].upper())]
    rows += [("long1", "g", "train", "lang " * 30_000 + " ".join(map(str, range(500)))), ("long2", "g", "test", "lang " * 30_001 + " ".join(map(str, range(500))))]
    rows += AWKWARD if awkward else []
    # Columns whose names clash with those that the operators use inside.
    return rows, spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "document_id string, grp2 string, part string, body string, id int, text string, band int")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows, df = table(spark, seed)
    members, links = neardup.near_duplicates(df, "document_id", "body", "grp2", 0.7, 3)
    got = {(r["a"], r["b"]) for r in neardup.member_pairs(members, links).collect()}
    keep = {r[0]: r for r in rows if r[0] and r[1]}
    want = {(a, b) for a, b in itertools.combinations(sorted(keep), 2) if keep[a][1] == keep[b][1] and similarity(keep[a][3], keep[b][3], 3) >= 0.7}
    assert got == want and len(want) > 10
    classes = {r["document_id"]: r for r in neardup.duplicate_classes(members, links).collect()}
    assert classes["copy1"]["class_id"] == classes["d005"]["class_id"] and classes["copy1"]["copies"] >= 2


def test_prefixes_shorten_until_the_recall_holds(spark):
    rows, df = table(spark, 4)
    few = neardup.near_duplicates(df, "document_id", "body", "grp2", 0.7, 3, recall=0.9999, floor=0.0, trees=2, depth=6)
    got = {(r["a"], r["b"]) for r in neardup.member_pairs(*few).collect()}
    keep = {r[0]: r for r in rows if r[0] and r[1]}
    want = {(a, b) for a, b in itertools.combinations(sorted(keep), 2) if keep[a][1] == keep[b][1] and similarity(keep[a][3], keep[b][3], 3) >= 0.7}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("seed", [1, 3])
def test_overlaps_equal_brute_force(spark, seed):
    rows, df = table(spark, seed)
    members, links = splitoverlap.split_overlaps(df, "document_id", "body", "part", threshold=0.7, k=3)
    got = {tuple(sorted((r["train_id"], r["held_id"]))) for r in splitoverlap.overlap_pairs(members, links).collect()}
    side = {}
    for r in rows:
        if r[0] and r[2] and r[3] and r[3].strip():
            side.setdefault(r[0], (r[2].strip().lower(), r[3]))
    want = {tuple(sorted((a, b))) for a in side for b in side if a != b and side[a][0] == "train" and side[b][0] != "train" and similarity(side[a][1], side[b][1], 3) >= 0.7}
    assert got == want and len(want) > 5
    held = splitoverlap.overlapping_held_out(members, links).collect()
    assert {r["id"] for r in held} == {b for a, b in ((x, y) for p in want for x, y in (p, p[::-1])) if side[b][0] != "train"}


def test_hot_keys_are_cut_into_blocks_and_stay_whole(spark):
    from veilspark.functions.hotjoin import blocked_join

    left = spark.range(300).selectExpr("if(id < 250, 0, id) as k", "id as a")
    right = spark.range(90).selectExpr("if(id < 80, 0, id + 200) as k", "id as b")
    want = {(r["a"], r["b"]) for r in left.join(right, "k").collect()}
    got = blocked_join(left, right, ["k"], ["a"], block=40)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "document_id string, grp2 string, part string, body string")
    assert neardup.member_pairs(*neardup.near_duplicates(df, "document_id", "body", "grp2", 0.7, 3)).count() == 0
    assert splitoverlap.overlap_pairs(*splitoverlap.split_overlaps(df, "document_id", "body", "part")).count() == 0
    requests = spark.createDataFrame([], "request_id long, scenario string, language string")
    targets = spark.createDataFrame([("scenario", "a", 1.0, 2), ("language", "en", 1.0, 1)], "field string, category string, target_share double, min_rows int")
    sample, report = quotasample.quota_sample(requests, targets, "request_id", ["scenario", "language"])
    assert sample.count() == 0 and report.where("short").count() == 2


def test_sample_meets_margins_and_reports_shortfalls(spark):
    rnd = random.Random(3)
    rows = [(i % 900, rnd.choice([" A", "a", "b", "B ", "c", None]), rnd.choice(["en", "EN", "de"]), i) for i in range(1000)] + [(None, "a", "en", 1)]
    df = spark.createDataFrame(rows, "request_id long, scenario string, language string, quota long")
    targets = spark.createDataFrame([("scenario", "a", 0.5, 1), ("scenario", "b", 0.3, 1), ("scenario", "c", 0.2, 1), ("scenario", "d", 0.0, 3), ("language", "en", 0.5, 1), ("language", "de", 0.5, 1)], "field string, category string, target_share double, min_rows int")
    sample, report = quotasample.quota_sample(df, targets, "request_id", ["scenario", "language"], seed=1)
    got, lines = sample.toPandas(), {(r["field"], r["category"]): r for r in report.collect()}
    assert len(got) == 450 == got.id.nunique()
    assert lines["scenario", "d"]["short"] and not lines["scenario", "a"]["short"]
    for f in ("scenario", "language"):
        for c, n in got[f].value_counts().items():
            assert lines[f, c]["drawn"] == n
    assert abs(lines["language", "en"]["drawn"] - 225) <= 1 and abs(lines["scenario", "a"]["drawn"] - 225) <= 1
    again, _ = quotasample.quota_sample(df, targets, "request_id", ["scenario", "language"], seed=1)
    assert set(again.toPandas().id) == set(got.id)


def test_rounding_keeps_both_margins():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = rng.random((4, 5)) * 7
        whole = rng.integers(3, 9, (4, 5))
        rows, cols = whole.sum(1), whole.sum(0)
        y = quotasample.round_table(quotasample.rake(x, [rows, cols], np.full((4, 5), 1e9)), rows, cols, np.full((4, 5), 10**6))
        assert (y.sum(1) == rows).all() and (y.sum(0) == cols).all() and (y >= 0).all()
