"""Metrics, thresholds, KS tests, ADWIN and snapshots."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.errors import DataContractError
from ledgerlens.operators import adwin, drift, metrics


def graded(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "target int, score double")


def test_separable_case(spark):
    df = graded(spark, [0, 0, 1, 1], [0.10, 0.35, 0.65, 0.90])
    row = metrics.evaluate(df, 0.65).first()
    for name in ("accuracy", "roc_auc", "pr_auc", "f1", "precision", "recall", "ks"):
        assert row[name] == 1.0, name
    assert (row["true_negative"], row["false_positive"], row["false_negative"],
            row["true_positive"]) == (2, 0, 0, 2)
    assert row["brier"] == pytest.approx((0.01 + 0.1225 + 0.1225 + 0.01) / 4)
    assert metrics.f1_threshold(df).first()["threshold"] == 0.65


@pytest.mark.parametrize("task_rows", [1_000_000, 5])
def test_ranking_metrics_against_pairs(spark, task_rows):
    rng = random.Random(11)
    labels = [int(rng.random() < 0.3) for _ in range(400)]
    scores = [round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2) for y in labels]
    df = graded(spark, labels, scores)
    curve = metrics.score_curve(df, task_rows=task_rows)
    row = metrics.ranking_metrics(curve).first()
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    pairs = [(a > b) + 0.5 * (a == b) for a in pos for b in neg]
    assert row["roc_auc"] == pytest.approx(np.mean(pairs))
    steps, seen_p, seen, ap, ks = sorted(set(scores), reverse=True), 0, 0, 0.0, 0.0
    for s in steps:
        here = sum(a == s for a in pos)
        seen_p += here
        seen += here + sum(b == s for b in neg)
        ap += here / len(pos) * seen_p / seen
        ks = max(ks, seen_p / len(pos) - (seen - seen_p) / len(neg))
    assert row["pr_auc"] == pytest.approx(ap)
    assert metrics.score_ks(curve).first()["ks"] == pytest.approx(ks)
    best = metrics.f1_threshold(df, task_rows=task_rows).first()
    f1 = {t: 2 * sum(a >= t for a in pos) / (sum(s >= t for s in scores) + len(pos)) for t in steps}
    top = max(f1.values())
    near = [t for t, v in f1.items() if abs(v - top) <= 1e-8 + 1e-5 * top]
    assert best["threshold"] == min(near, key=lambda t: (abs(t - 0.5), t))


def test_threshold_ties_prefer_middle_then_lower(spark):
    # Every threshold below the positives gives the same F1 only at ties of rank.
    df = graded(spark, [1, 0, 0, 1], [0.9, 0.6, 0.4, 0.4])
    assert metrics.f1_threshold(df).first()["threshold"] in (0.4, 0.9)


def test_groups_with_one_class_keep_counts(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.4), ("a", 0, 0.2), ("b", 0, 0.7)], "g string, target int, score double")
    rows = {r["g"]: r for r in metrics.evaluate(df, 0.5, by=["g"]).collect()}
    assert rows["a"]["roc_auc"] == 1.0 and rows["a"]["f1"] == 0.0
    assert rows["b"]["roc_auc"] is None and rows["b"]["ks"] is None
    assert rows["b"]["false_positive"] == 1


def test_score_requirements(spark):
    with pytest.raises(DataContractError, match="invalid"):
        metrics.require_scores(graded(spark, [0, 1], [0.1, 1.2]))
    with pytest.raises(DataContractError, match="both"):
        metrics.require_scores(graded(spark, [1, 1], [0.1, 0.2]))


def test_candidate_choice(spark):
    rows = [(0, 1, .9, .7, .5, .5, .5, .2), (1, 1, .9, .7, .6, .5, .5, .2), (2, 1, .9, .7, .6, .5, .5, .2)]
    df = spark.createDataFrame(
        [(r[0], r[1], 0.5, *r[2:7], ) for r in rows],
        "candidate int, fold int, accuracy double, roc_auc double, pr_auc double, f1 double, "
        "ks double, brier double")
    assert metrics.select_candidate(df).first()["candidate"] == 1


def brute_p_values(n, m):
    counts, total = {}, 0
    for first in itertools.combinations(range(n + m), n):
        chosen, i, j, gap = set(first), 0, 0, 0
        for t in range(n + m):
            i, j = (i + 1, j) if t in chosen else (i, j + 1)
            gap = max(gap, abs(i * m - j * n))
        counts[gap] = counts.get(gap, 0) + 1
        total += 1
    return {g / (n * m): sum(v for k, v in counts.items() if k >= g) / total for g in counts}


@pytest.mark.parametrize("n, m", [(3, 3), (3, 4), (5, 5), (4, 6), (1, 5), (6, 2)])
def test_exact_p_values(n, m):
    for gap, p in brute_p_values(n, m).items():
        assert drift.ks_p_value(gap, n, m) == pytest.approx(p, abs=1e-12)


def test_p_value_limits():
    assert drift.ks_p_value(1.0, 3, 3) == pytest.approx(0.1)
    assert drift.ks_p_value(0.0, 5, 7) == 1.0


@pytest.mark.parametrize("n, m, gap", [
    (10_001, 40, 0.22), (20_000, 50, 0.2), (9_000, 9_000, 0.03), (12_000, 8_000, 0.008)])
def test_p_value_series_meets_the_exact_count(n, m, gap, monkeypatch):
    exact = drift._exact_p(gap, n, m)
    monkeypatch.setattr(drift, "EXACT_LIMIT", 0)
    assert drift.ks_p_value(gap, n, m) == pytest.approx(exact, rel=0.01)
    # Both forms of the distribution meet.
    assert drift._series_p(1.1799e-3, 1e6) == pytest.approx(
        drift._series_p(1.1801e-3, 1e6), abs=1e-3)


@pytest.mark.parametrize("task_rows", [1_000_000, 3])
def test_ks_statistic_against_numpy(spark, task_rows):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300).round(2), rng.normal(0.3, 1.2, size=200).round(2)
    ref = spark.createDataFrame([(float(x), float(x) * 1000) for x in a], "u double, w double")
    cur = spark.createDataFrame([(float(x), float(x) * 1000) for x in b], "u double, w double")
    grid = np.union1d(a, b)
    gap = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    rows = drift.ks_statistics(ref, cur, task_rows=task_rows).collect()
    assert len(rows) == 2
    for row in rows:
        assert row["statistic"] == pytest.approx(gap)
        assert (row["reference_count"], row["current_count"]) == (300, 200)


def test_ks_drift_and_snapshot(spark):
    ref = spark.createDataFrame([(1.0,), (1.1,), (0.9,)], "dti double")
    cur = spark.createDataFrame([(10.0,), (11.0,), (12.0,)], "dti double")
    row = drift.ks_drift(ref, cur, alpha=0.5).first()
    assert row["drift_detected"] and row["p_value"] == pytest.approx(0.1)
    assert not drift.ks_drift(ref, cur, alpha=0.1 - 1e-12).first()["drift_detected"]
    snapshot = drift.feature_snapshot(drift.ks_drift(ref, cur, alpha=0.5)).first()
    assert (snapshot["status"], snapshot["feature_drift_count"]) == ("drift_detected", 1)
    with pytest.raises(DataContractError):
        drift.ks_drift(ref, cur, alpha=1.0)


def test_comparable_columns(spark):
    ref = spark.createDataFrame(
        [("100", 1, "1", 1.0), ("200", 0, None, 2.0), ("bad", 1, None, 3.0)],
        "income string, target int, sparse string, reference_only double")
    cur = spark.createDataFrame(
        [(110.0, 1, "1"), (220.0, 0, None), (None, 1, None)],
        "income double, target int, sparse string")
    row, = drift.comparable_columns(ref, cur).collect()
    assert (row["feature"], row["reference_count"], row["current_count"]) == ("income", 2, 2)


def test_demo_cohort_is_fully_apart(spark):
    ref = spark.range(100).selectExpr("45000 + 100 * id AS annual_inc", "8 + 0.05D * id AS dti")
    cur = spark.range(100).selectExpr("95000 + 100 * id AS annual_inc", "32 + 0.05D * id AS dti")
    for row in drift.ks_drift(ref, cur).collect():
        assert row["statistic"] == 1.0 and row["drift_detected"]


def stream(spark, scores, model="m"):
    rows = [(i, model, float(s), i) for i, s in enumerate(scores)]
    return spark.createDataFrame(
        rows, "prediction_id long, model_version string, score double, at long"
    ).selectExpr("prediction_id", "model_version", "score",
                 "timestamp_seconds(1700000000 + at) AS created_at")


def test_adwin_finds_a_step_and_not_a_plateau(spark):
    rng = np.random.default_rng(0)
    flat = np.clip(rng.normal(0.3, 0.05, 1500), 0, 1)
    step = np.concatenate([flat[:800], np.clip(rng.normal(0.7, 0.05, 700), 0, 1)])
    df = stream(spark, flat, "flat").unionByName(stream(spark, step, "step"))
    rows = {r["model_version"]: r for r in adwin.detect(df.repartition(5)).collect()}
    assert rows["flat"]["detections"] == 0 and rows["flat"]["score_stream_count"] == 1500
    assert rows["flat"]["window_width"] == 1500
    assert rows["step"]["detections"] >= 1
    assert rows["step"]["window_mean"] == pytest.approx(0.7, abs=0.05)
    assert rows["step"]["latest_score"] == pytest.approx(step[-1])


def test_adwin_detects_soon_after_a_step():
    rng = np.random.default_rng(5)
    detector, found = adwin.Detector(), None
    scores = np.concatenate([rng.normal(0.2, 0.05, 640), rng.normal(0.6, 0.05, 640)])
    for at, score in enumerate(scores):
        if detector.add(score) and found is None:
            found = at
    assert 640 <= found <= 640 + 64
    assert len(detector.buckets) < 40
    with pytest.raises(DataContractError):
        adwin.Detector(delta=1.5)


def test_histogram_keeps_totals():
    detector = adwin.Detector(delta=1e-12)
    values = np.random.default_rng(1).random(32 * 50)
    for value in values:
        detector.add(value)
    assert detector.width == len(values)
    assert detector.mean == pytest.approx(values.mean())
    squares = sum(b[2] for b in detector.buckets) + sum(
        b[0] * (b[1] - values.mean()) ** 2 for b in detector.buckets)
    assert squares == pytest.approx(values.var() * len(values))


def test_a_short_stream_can_alarm_and_a_primed_one_sooner(spark):
    short = stream(spark, [0.1] * 40 + [0.9] * 40)
    assert adwin.detect(short).first()["detections"] >= 1
    primed = adwin.detect(stream(spark, [0.1] * 200))
    later = stream(spark, [0.9] * 24)
    assert adwin.detect(later).first()["detections"] == 0
    row = adwin.detect(later, initial=primed).first()
    assert row["detections"] == 1 and row["score_stream_count"] == 224
    whole = adwin.detect(stream(spark, [0.1] * 200 + [0.9] * 24)).first()
    assert row.asDict() == whole.asDict()
    replayed = adwin.replay_state(
        later.drop("model_version"), spark.createDataFrame(
            [], "snapshot_id int, snapshot string, created_at timestamp"), primed=primed).first()
    assert replayed["score_stream_count"] == 24 and replayed["status"] == "drift_detected"


def test_replay_merges_snapshot(spark):
    predictions = stream(spark, [0.2, 0.8]).drop("model_version")
    good = {"feature": "dti", "statistic": 0.5, "p_value": 0.001, "drift_detected": True,
            "reference_count": 10, "current_count": 12}
    saved = json.dumps({
        "score_stream_count": 42, "latest_score": 0.1, "adwin_change_detected": False,
        "updated_at": "not a time", "feature_results": [good, {"feature": "broken"}]})
    snapshots = spark.createDataFrame([(1, saved)], "snapshot_id int, snapshot string").withColumn(
        "created_at", F.current_timestamp())
    row = adwin.replay_state(predictions, snapshots).first()
    assert (row["status"], row["score_stream_count"]) == ("drift_detected", 42)
    assert row["latest_score"] == 0.8 and row["updated_at"] is None
    assert len(row["feature_results"]) == 1
    empty = adwin.replay_state(predictions.limit(0), snapshots).first()
    assert empty["latest_score"] == 0.1
    alone = adwin.replay_state(predictions, snapshots.limit(0)).first()
    assert (alone["status"], alone["score_stream_count"]) == ("stable", 2)


def test_status_precedence(spark):
    frame = spark.createDataFrame(
        [(True, 0, 0), (False, 2, 5), (False, 0, 5), (False, 0, 0)], "a boolean, f int, s int")
    got = [r[0] for r in frame.select(
        drift.drift_status(F.col("a"), F.col("f"), F.col("s"))).collect()]
    assert got == ["drift_detected", "drift_detected", "stable", "not_observed"]


def by_one_walk(values, start=0):
    """What a single detector sees: (changes, final state)."""
    detector, changes = adwin.Detector(), []
    for n, value in enumerate(values, 1):
        if detector.add(value):
            changes.append((n, detector.width))
    return changes, detector


@pytest.mark.parametrize("chunk", [100, 512])
def test_chunks_walked_at_once_agree_with_one_walk(spark, chunk):
    rng = random.Random(chunk)
    levels = {"steady": [0.4] * 900, "steps": [0.1] * 500 + [0.8] * 300 + [0.3] * 400,
              "short": [0.5] * 7, "drift": [k / 1500 for k in range(1500)]}
    values = {name: [min(1.0, max(0.0, v + rng.gauss(0, 0.05))) for v in row]
              for name, row in levels.items()}
    rows = [(name, f"{k:06d}", k, v) for name, row in values.items() for k, v in enumerate(row)]
    df = spark.createDataFrame(rows, "model_version string, prediction_id string, k long, "
                                     "score double").withColumn(
        "created_at", F.timestamp_seconds("k")).repartition(7)
    found = adwin.walk(df, chunk=chunk).collect()
    for name, row in values.items():
        changes, detector = by_one_walk(row)
        mine = [r for r in found if r.model_version == name]
        assert sorted((r.last_change_at, r.window_width) for r in mine if not r.final) == changes
        final, = [r for r in mine if r.final]
        assert final.bucket_counts == [n for n, _, _ in detector.buckets]
        assert final.bucket_means == pytest.approx([m for _, m, _ in detector.buckets], abs=1e-9)
        assert final.bucket_squares == pytest.approx([q for *_, q in detector.buckets], abs=1e-7)
        assert (final.score_stream_count, final.fresh) == (len(row), len(row))
        assert final.detections == len(changes) == detector.detections


def test_chunks_go_on_from_a_stored_state(spark):
    rng = random.Random(5)
    values = [min(1.0, max(0.0, 0.3 + rng.gauss(0, 0.1))) for _ in range(700)] + [
        min(1.0, 0.7 + rng.random() / 10) for _ in range(300)]
    first = adwin.detect(stream(spark, values[:250]), chunk=64)
    row = adwin.detect(stream(spark, values[250:]), initial=first, chunk=64).first()
    _, detector = by_one_walk(values)
    assert row.bucket_counts == [n for n, _, _ in detector.buckets]
    assert row.score_stream_count == 1000 and row.detections == detector.detections > 0
    idle = adwin.detect(stream(spark, values[:5]).filter("false"), initial=first, chunk=64).first()
    assert idle.bucket_counts == first.first().bucket_counts


def test_sizes_without_scores():
    detector = adwin.Detector()
    sizes = {0: []}
    for n in range(1, 700):
        detector.buckets.insert(0, (1, 0.5, 0.0))
        detector._compress()
        sizes[n] = [b[0] for b in detector.buckets]
    for start in (0, 1, 17, 300):
        for end in range(start, 700, 13):
            assert adwin.sizes_after(sizes[start], end - start) == sizes[end]
