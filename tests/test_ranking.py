"""Distributed order helpers against plain Python, on their large-data paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranking


@pytest.fixture
def skewed(spark):
    """One key holds most rows and one value repeats a lot."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"),
             0.5 if rng.random() < 0.4 else round(rng.random(), 3), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v double, id long").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys, range_keys", [(["k"], []), (["k"], ["k"]), ([], [])])
def test_running_totals_match_simple_path(skewed, keys, range_keys, descending):
    _, df = skewed
    distinct = df.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    sums = {"n": "cn", "s": "cs"}
    small = ranking.running_totals(distinct, keys, "v", sums, descending=descending)
    large = ranking.running_totals(
        distinct, keys, "v", sums, descending=descending, range_keys=range_keys,
        task_rows=10, ranges=16)
    order = [*keys, "v", "cn", "cs"]
    assert sorted(map(tuple, small.select(*order).collect())) == sorted(
        map(tuple, large.select(*order).collect()))


def test_numbered_matches_sorting(skewed):
    rows, df = skewed
    got = {r["id"]: r["position"] for r in ranking.numbered(df, ["k"], ["v", "id"]).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("task_rows", [1_000_000, 400, 25])
def test_exact_percentiles(spark, task_rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=1500), np.zeros(900), rng.integers(0, 9, 601)])
    rng.shuffle(values)
    rows = [(float(v), float(v) ** 3 if i % 3 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    probs = [0.1, 0.25, 0.5, 0.75, 0.999]
    found = ranking.exact_percentiles(df, ["a", "b"], probs, task_rows=task_rows)
    cubes = [r[1] for r in rows if r[1] is not None]
    assert found["a"] == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    assert found["b"] == pytest.approx(list(np.quantile(cubes, probs)), abs=1e-9)


def test_exact_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert ranking.exact_percentiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}
    assert ranking.exact_percentiles(df, ["a", "b"], [0.5], task_rows=0) == {
        "a": [None], "b": [1.0]}


@pytest.mark.parametrize("count", [0, 1, 137, 2999, 3000])
@pytest.mark.parametrize("task_rows", [10_000, 1])
def test_smallest_hashes_is_exact(skewed, count, task_rows):
    rows, df = skewed
    digest = F.xxhash64(F.lit(5), F.col("id"))
    chosen = ranking.smallest_hashes(df, digest, "id", count, task_rows=task_rows)
    if not count:
        assert chosen is None
        return
    hashed = sorted((r["h"], r["id"]) for r in df.select(digest.alias("h"), "id").collect())
    got = {r["id"] for r in df.filter(chosen).select("id").collect()}
    assert got == {i for _, i in hashed[:count]}


def test_smallest_hashes_with_colliding_digests(spark):
    df = spark.range(500)
    chosen = ranking.smallest_hashes(df, F.lit(7).cast("long"), "id", 123, task_rows=1)
    assert {r[0] for r in df.filter(chosen).collect()} == set(range(123))


def test_latest_by_limits_before_the_shuffle(spark, skewed):
    _, df = skewed
    latest = ranking.latest_by(df, ["k"], [F.col("id").desc()])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_brackets_of_a_median_need_no_estimate(spark, monkeypatch):
    """Both middle ranks share one histogram, and a bin of one repeated value is not sorted."""
    def refuse(*_):
        raise AssertionError("approximate percentiles or sorted values are not needed here")

    monkeypatch.setattr(ranking.F, "percentile_approx", refuse)
    df = spark.range(40_000).select(
        (F.col("id") % 4).cast("double").alias("few"), (F.col("id") * 0.37).alias("many"))
    found = ranking.exact_percentiles(df, ["few", "many"], [0.5], task_rows=500)
    assert found["few"] == [1.5]
    assert found["many"][0] == pytest.approx(19_999.5 * 0.37, abs=1e-9)


def test_percentiles_beside_outliers_and_nan(spark):
    rows = [(float(i), float(i)) for i in range(999)] + [(1e300, float("nan"))]
    df = spark.createDataFrame(rows, "far double, broken double")
    found = ranking.exact_percentiles(df, ["far", "broken"], [0.0, 0.5], task_rows=10)
    assert found == {"far": [0.0, 499.5], "broken": [0.0, 499.5]}
