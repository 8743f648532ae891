"""Seeded, audited shifts of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions.parse import finite_or_null
from ledgerlens.operators.ranking import exact_percentiles, smallest_hashes

DEFAULT_FEATURES = ("int_rate", "dti")
SUMMARY_FIELDS = (
    "row_count", "non_null_count", "missing_count", "finite_count", "non_finite_count",
    "mean", "std", "minimum", "q25", "median", "q75", "maximum",
)


@dataclass(frozen=True)
class Shift:
    """``absolute`` adds ``amount``; ``relative`` multiplies by ``1 + amount``."""

    feature: str
    amount: float
    mode: str = "absolute"
    fraction: float = 1.0
    lower: float | None = None
    upper: float | None = None
    allowed: tuple[str, ...] = DEFAULT_FEATURES

    def __post_init__(self) -> None:
        if self.feature not in self.allowed:
            raise DataContractError(f"feature must be one of {sorted(self.allowed)}")
        if self.mode not in ("absolute", "relative"):
            raise DataContractError("mode must be 'absolute' or 'relative'")
        bounds = [b for b in (self.lower, self.upper) if b is not None]
        if not all(math.isfinite(x) for x in (self.amount, self.fraction, *bounds)):
            raise DataContractError("shift, fraction and clip bounds must be finite")
        if not 0 <= self.fraction <= 1:
            raise DataContractError("fraction must lie in [0, 1]")
        if len(bounds) == 2 and self.lower > self.upper:
            raise DataContractError("clip lower bound must not exceed the upper bound")

    def moved(self) -> Column:
        value = F.col(self.feature).cast("double")
        moved = (
            value + F.lit(float(self.amount)) if self.mode == "absolute"
            else value * F.lit(1.0 + self.amount)
        )
        if self.lower is not None:
            moved = F.greatest(moved, F.lit(float(self.lower)))
        if self.upper is not None:
            moved = F.least(moved, F.lit(float(self.upper)))
        return moved


def sample_size(eligible: int, fraction: float) -> int:
    """Halves round up, and a positive fraction always takes at least one row."""
    if eligible == 0 or fraction == 0:
        return 0
    return min(eligible, max(1, math.floor(eligible * fraction + 0.5)))


def check_protected(
    df: DataFrame, shifts: Sequence[Shift], protected: Sequence[str], seed: int
) -> None:
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise DataContractError("seed must be a non-negative integer")
    absent = sorted(set(protected) - set(df.columns))
    if absent:
        raise DataContractError(f"protected columns missing: {absent}")
    for shift in shifts:
        if shift.feature in protected:
            raise DataContractError(f"{shift.feature!r} is protected")
        if shift.feature not in df.columns:
            raise DataContractError(f"{shift.feature!r} is missing")
        if not isinstance(df.schema[shift.feature].dataType, T.NumericType):
            raise DataContractError(f"{shift.feature!r} must be numeric")


def is_finite(feature: str) -> Column:
    return finite_or_null(F.col(feature).cast("double")).isNotNull()


def selection(
    df: DataFrame, shift: Shift, *, seed: int, operation: int, row_id: str
) -> tuple[Column, int, int]:
    """(predicate, eligible rows, selected rows). The sample is the ``k`` eligible
    rows with the smallest seeded hash: exact in size, independent per operation,
    and the same on any partitioning."""
    eligible = df.agg(F.count_if(is_finite(shift.feature)).alias("n")).first()["n"]
    wanted = sample_size(eligible, shift.fraction)
    if wanted == eligible:
        return is_finite(shift.feature), eligible, wanted
    digest = F.xxhash64(F.lit(seed), F.lit(operation), F.col(row_id))
    chosen = smallest_hashes(df.filter(is_finite(shift.feature)), digest, row_id, wanted)
    if chosen is None:
        return F.lit(False), eligible, 0
    return is_finite(shift.feature) & chosen, eligible, wanted


def shifted(df: DataFrame, shift: Shift, selected: Column) -> DataFrame:
    value = F.col(shift.feature).cast("double")
    return df.withColumn(shift.feature, F.when(selected, shift.moved()).otherwise(value))


def shift_all_rows(df: DataFrame, shift: Shift) -> DataFrame:
    """The fraction-1 case: a projection, no counting needed."""
    return shifted(df, shift, is_finite(shift.feature))


def apply_shifts(
    df: DataFrame,
    shifts: Sequence[Shift],
    *,
    seed: int = 0,
    row_id: str = S.LOAN_ID,
    protected: Sequence[str] = (),
) -> DataFrame:
    """Apply shifts in order; every other column stays as it is."""
    check_protected(df, shifts, protected, seed)
    current = df
    for operation, shift in enumerate(shifts):
        selected, _, _ = selection(current, shift, seed=seed, operation=operation, row_id=row_id)
        current = shifted(current, shift, selected)
    return current


def _summary_columns(name: str, quartiles: Sequence[float | None]) -> list[Column]:
    """The twelve summary aggregates of one double column."""
    value = F.col(name)
    usable = finite_or_null(value)
    missing = value.isNull() | F.isnan(value)
    low, mid, high = quartiles
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~missing).alias("non_null_count"),
        F.count_if(missing).alias("missing_count"),
        F.count(usable).alias("finite_count"),
        F.count_if(~missing & usable.isNull()).alias("non_finite_count"),
        F.avg(usable).alias("mean"),
        F.stddev_pop(usable).alias("std"),
        F.min(usable).alias("minimum"),
        F.lit(low).cast("double").alias("q25"),
        F.lit(mid).cast("double").alias("median"),
        F.lit(high).cast("double").alias("q75"),
        F.max(usable).alias("maximum"),
    ]


def _quartiles(df: DataFrame, names: Sequence[str]) -> dict[str, list[float | None]]:
    finite = df.select(*[finite_or_null(c).alias(c) for c in names])
    return exact_percentiles(finite, list(names), [0.25, 0.5, 0.75])


def numeric_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature with the twelve summary fields over finite values."""
    names = list(features)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    quartiles = _quartiles(values, names)
    return values.agg(*[
        F.struct(F.lit(c).alias("feature"), *_summary_columns(c, quartiles[c])).alias(c)
        for c in names
    ]).select(F.explode(F.array(*[F.col(c) for c in names])).alias("s")).select("s.*")


def perturb_with_report(
    df: DataFrame,
    shifts: Sequence[Shift],
    *,
    seed: int = 0,
    row_id: str = S.LOAN_ID,
    protected: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(perturbed rows, report rows). One report row per shift: eligible, selected
    and changed rows, a digest over the selected ids, summaries before and after."""
    check_protected(df, shifts, protected, seed)
    current, reports = df, []
    for operation, shift in enumerate(shifts):
        selected, eligible, taken = selection(
            current, shift, seed=seed, operation=operation, row_id=row_id
        )
        following = shifted(current, shift, selected)
        both = current.select(
            F.col(shift.feature).cast("double").alias("before"),
            F.when(selected, shift.moved())
            .otherwise(F.col(shift.feature).cast("double")).alias("after"),
            F.when(selected, F.xxhash64(row_id)).alias("_selected"),
        )
        quartiles = _quartiles(both, ["before", "after"])
        report = both.agg(
            F.count_if(F.col("_selected").isNotNull() & (F.col("before") != F.col("after")))
            .alias("changed_rows"),
            F.bit_xor("_selected").alias("selected_digest"),
            F.struct(*_summary_columns("before", quartiles["before"])).alias("b"),
            F.struct(*_summary_columns("after", quartiles["after"])).alias("a"),
        )
        reports.append(
            report.select(
                F.lit(operation).alias("operation"),
                F.lit(shift.feature).alias("feature"),
                F.lit(shift.mode).alias("mode"),
                F.lit(float(shift.amount)).alias("shift"),
                F.lit(float(shift.fraction)).alias("fraction"),
                F.lit(eligible).cast("long").alias("eligible_rows"),
                F.lit(taken).cast("long").alias("selected_rows"),
                "changed_rows",
                "selected_digest",
                *[F.col(f"b.{f}").alias(f"before_{f}") for f in SUMMARY_FIELDS],
                *[F.col(f"a.{f}").alias(f"after_{f}") for f in SUMMARY_FIELDS],
            )
        )
        current = following
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    return current, report
