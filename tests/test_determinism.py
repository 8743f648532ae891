"""Results do not depend on partitioning or task order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import adwin, drift, features, metrics, outcomes, perturb, review, splits


@pytest.fixture
def scores(spark):
    rng = np.random.default_rng(6)
    values = np.clip(np.concatenate([rng.normal(0.4, 0.1, 900), rng.normal(0.8, 0.1, 500)]), 0, 1)
    rows = [(i, "hot" if i % 10 else "cold", float(v), i // 7, int(v > 0.5 + 0.3 * (i % 3 - 1)))
            for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "prediction_id long, model_version string, score double, at long, target int"
    ).withColumn("created_at", F.timestamp_seconds("at"))


def everything(frame, raw):
    typed = features.type_columns(outcomes.resolve(raw))
    labelled = splits.plan_split(typed).apply(typed)
    shift = perturb.Shift("score", 0.1, fraction=0.3, allowed=("score",))
    moved = perturb.apply_shifts(frame, [shift], seed=3, row_id="prediction_id")
    early, late = frame.filter("at < 100"), frame.filter("at >= 100")
    return {
        "fit": features.fit(labelled.filter("dataset_split = 'train'")),
        "moved": sorted(map(tuple, moved.select("prediction_id", "score").collect())),
        "threshold": metrics.f1_threshold(frame).collect(),
        "ks": sorted((r["feature"], r["statistic"], r["p_value"]) for r in drift.ks_drift(
            early.select("score", "target"), late.select("score")).collect()),
        "adwin": sorted(map(str, adwin.detect(frame).drop(
            "window_mean", "bucket_means", "bucket_squares").collect())),
        "latest": sorted(map(tuple, review.latest_by(
            frame.select("model_version", "at", "prediction_id"), ["model_version"],
            [F.col("at").desc(), F.col("prediction_id").desc()]).collect())),
    }


def test_one_and_many_partitions_agree(spark, scores, raw_loans):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        single = everything(scores.coalesce(1), raw_loans.coalesce(1))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        many = everything(scores.repartition(8), raw_loans.repartition(8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert single.pop("fit").matches(many.pop("fit"))
    assert single == many
