"""Two-sample Kolmogorov-Smirnov drift checks and drift snapshots."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import parse
from ledgerlens.operators.ranking import TASK_ROWS, running_totals
from ledgerlens.session import materialise

METADATA = (S.TARGET, S.ISSUE_DATE, S.QUARTER, S.SPLIT)
EXACT_LIMIT = 20_000
FEATURE_RESULT = (
    "struct<feature:string,statistic:double,p_value:double,drift_detected:boolean,"
    "reference_count:bigint,current_count:bigint>"
)
SNAPSHOT = (
    "struct<status:string,score_stream_count:bigint,latest_score:double,"
    "adwin_change_detected:boolean,feature_drift_count:bigint,updated_at:string,"
    f"feature_results:array<{FEATURE_RESULT}>>"
)


def as_number(df: DataFrame, column: str) -> Column:
    """Lenient numeric reading: text that is no number counts as missing."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        number = F.col(column).cast("double")
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = parse.strip(column)
        number = parse.plain_number(text)
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number), number)


def stacked_cohorts(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, value, in_reference, in_current), pre-aggregated per distinct
    value: all shared features travel in one shuffle."""
    shared = [c for c in reference.columns if c in current.columns and c not in METADATA]
    if not shared:
        raise DataContractError("the cohorts share no feature column")

    def long(df: DataFrame, is_reference: int) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(c).alias("feature"), as_number(df, c).alias("value")) for c in shared
        ])
        return df.select(F.explode(pairs).alias("p")).select(
            "p.feature", (F.col("p.value") + F.lit(0.0)).alias("value"),
            F.lit(is_reference).alias("r"), F.lit(1 - is_reference).alias("c"),
        ).filter(F.col("value").isNotNull())

    return (
        long(reference, 1).unionByName(long(current, 0))
        .groupBy("feature", "value")
        .agg(F.sum("r").alias("in_reference"), F.sum("c").alias("in_current"))
    )


def comparable_columns(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Shared non-metadata columns with at least two numbers on each side."""
    return _comparable(stacked_cohorts(reference, current))


def _comparable(stacked: DataFrame) -> DataFrame:
    return (
        stacked.groupBy("feature")
        .agg(
            F.sum("in_reference").alias("reference_count"),
            F.sum("in_current").alias("current_count"),
        )
        .filter("reference_count >= 2 AND current_count >= 2")
    )


def ks_statistics(
    reference: DataFrame, current: DataFrame, *, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Per comparable feature: largest gap between the two empirical
    distributions, with both counts."""
    # Written once: the totals, the curve and its ranges all read it.
    stacked = materialise(stacked_cohorts(reference, current), "stacked")
    curve = running_totals(
        stacked, ["feature"], "value",
        {"in_reference": "below_reference", "in_current": "below_current"},
        range_keys=["feature"], task_rows=task_rows,
    )
    # One row per feature; features are bounded by the schema.
    totals = F.broadcast(_comparable(stacked))
    gap = F.abs(
        F.col("below_reference") / F.col("reference_count")
        - F.col("below_current") / F.col("current_count")
    )
    return curve.join(totals, "feature").groupBy("feature").agg(
        F.max(gap).alias("statistic"),
        F.first("reference_count").alias("reference_count"),
        F.first("current_count").alias("current_count"),
    )


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Two-sided p-value: exact lattice-path count while the samples are small together,
    else a series for the effective size; the two agree within 1 % where they meet."""
    if not (n and m):
        return float("nan")
    if n + m <= EXACT_LIMIT:
        return _exact_p(statistic, n, m)
    # The gap moves in steps of the lattice; a third of one makes up for it.
    step = 1 / math.lcm(int(n), int(m))
    return _series_p(statistic - 0.35 * step, n * m / (n + m))


def _exact_p(statistic: float, n: int, m: int) -> float:
    """P(D >= d) over all equally likely interleavings of the two samples.

    A random walk adds one observation per step. ``mass[i]`` is the probability of
    holding i of the first sample without any gap of d so far; whatever leaves the
    band is summed up, which stays accurate for tiny p-values.
    """
    common = int(np.gcd(n, m))
    # Gaps are multiples of 1 / lcm(n, m): compare integers, not doubles.
    step_i, step_j = m // common, n // common
    height = int(np.rint(statistic * (n // common * m)))
    if height <= 0:
        return 1.0
    both = step_i + step_j
    mass = np.zeros(n + 2)
    mass[0] = 1.0
    low, high, outside = 0, 0, 0.0
    for taken in range(n + m):
        left = n + m - taken
        i = np.arange(low, min(high + 1, n) + 1)
        stay = mass[i] * (m - (taken - i)) / left
        grow = np.where(i > 0, mass[i - 1], 0.0) * (n - i + 1) / left
        reached = stay + grow
        mass[i] = reached
        at = (taken + 1) * step_j
        new_low = max(low, (at - height) // both + 1)
        new_high = min(i[-1], -(-(at + height) // both) - 1)
        gone = (i < new_low) | (i > new_high)
        outside += float(reached[gone].sum())
        mass[i[gone]] = 0.0
        if new_low > new_high:
            return 1.0
        low, high = new_low, int(new_high)
    return float(min(1.0, outside))


def _series_p(statistic: float, size: float) -> float:
    """Kolmogorov's survival function at sqrt(size) * d, with Vrbik's correction of the
    argument for the finite size (Vrbik, 2018)."""
    x = np.sqrt(size) * statistic
    if x <= 0:
        return 1.0
    x += 1 / (6 * np.sqrt(size)) + (x - 1) / (4 * size)
    if x < 1.18:  # the theta-function form converges fast for small x
        k = np.arange(1, 20)
        below = np.sqrt(2 * np.pi) / x * np.exp(
            -((2 * k - 1) ** 2) * np.pi ** 2 / (8 * x * x)).sum()
        return float(min(1.0, max(0.0, 1.0 - below)))
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum())))


@F.pandas_udf(T.DoubleType())
def ks_p_values(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_p_value(d, int(a), int(b)) for d, a, b in zip(statistic, n, m)])


def ks_drift(
    reference: DataFrame, current: DataFrame, *, alpha: float = 0.01,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """KS statistic, p-value and drift flag per comparable feature."""
    if not 0 < alpha < 1:
        raise DataContractError("alpha must lie strictly between 0 and 1")
    if reference.isEmpty() or current.isEmpty():
        raise DataContractError("both cohorts must hold rows")
    return (
        ks_statistics(reference, current, task_rows=task_rows)
        .withColumn("p_value", ks_p_values("statistic", "reference_count", "current_count"))
        .withColumn("drift_detected", F.col("p_value") < F.lit(alpha))
        .select("feature", "statistic", "p_value", "drift_detected",
                "reference_count", "current_count")
    )


def drift_status(adwin_changed: Column, feature_drift_count: Column, scores: Column) -> Column:
    return (
        F.when(adwin_changed | (feature_drift_count > 0), "drift_detected")
        .when(scores > 0, "stable")
        .otherwise("not_observed")
    )


def feature_snapshot(results: DataFrame) -> DataFrame:
    """One snapshot row from KS results (one entry per feature, schema-bounded)."""
    entry = F.struct(
        "feature", "statistic", "p_value", "drift_detected", "reference_count", "current_count"
    )
    return results.agg(
        F.count_if(F.col("drift_detected")).alias("feature_drift_count"),
        F.count(F.lit(1)).alias("evaluated_features"),
        F.sort_array(F.collect_list(entry)).alias("feature_results"),
    ).withColumn(
        "status",
        drift_status(F.lit(False), F.col("feature_drift_count"), F.lit(0)),
    )


def read_snapshots(records: DataFrame, column: str = "snapshot") -> DataFrame:
    """Parse persisted snapshot JSON; malformed feature entries are skipped."""
    parsed = F.from_json(column, SNAPSHOT, {"mode": "PERMISSIVE"})
    complete = F.filter(
        F.coalesce(F.col("_s.feature_results"), F.array().cast(f"array<{FEATURE_RESULT}>")),
        lambda e: e["feature"].isNotNull() & e["statistic"].isNotNull()
        & e["p_value"].isNotNull() & e["drift_detected"].isNotNull()
        & e["reference_count"].isNotNull() & e["current_count"].isNotNull(),
    )
    return records.withColumn("_s", parsed).select(
        *records.columns,
        F.col("_s.score_stream_count").alias("score_stream_count"),
        F.col("_s.latest_score").alias("latest_score"),
        F.coalesce("_s.adwin_change_detected", F.lit(False)).alias("adwin_change_detected"),
        complete.alias("feature_results"),
        F.try_to_timestamp(F.col("_s.updated_at")).alias("updated_at"),
    )


def newest(df: DataFrame, limit: int, order: Sequence[str] = ("created_at",)) -> DataFrame:
    """The newest ``limit`` rows, oldest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit).orderBy(*order)


def top_drifting_features(records: DataFrame, top: int = 5) -> DataFrame:
    """Features found in the most snapshots."""
    return (
        records.select(F.explode("feature_results").alias("r"))
        .groupBy(F.col("r.feature").alias("feature"))
        .agg(F.count(F.lit(1)).alias("snapshots"))
        .orderBy(F.col("snapshots").desc(), "feature")
        .limit(top)
    )
