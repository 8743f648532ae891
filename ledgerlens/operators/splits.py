"""Quarter-aligned temporal splits and expanding-window folds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError


def check_fractions(train: float, validation: float, shift: float | None = None) -> float:
    remainder = 1.0 - train - validation
    resolved = remainder if shift is None else shift
    if not all(0 < f < 1 for f in (train, validation, resolved)) or train + validation >= 1:
        raise DataContractError("split fractions must lie strictly between 0 and 1")
    if abs(train + validation + resolved - 1.0) > 1e-9:
        raise DataContractError("split fractions must sum to 1")
    return resolved


def quarter_counts(total: int, train: float = 0.6, validation: float = 0.2) -> tuple[int, int]:
    """Quarters for train and validation; the rest, at least one, is shift."""
    if total < 3:
        raise DataContractError(f"at least three distinct quarters are needed, found {total}")
    n_train = max(1, math.floor(total * train))
    n_validation = max(1, math.floor(total * validation))
    if n_train + n_validation == total:  # lifting a zero to one used the last quarter
        if n_train >= n_validation:
            return n_train - 1, n_validation
        return n_train, n_validation - 1
    return n_train, n_validation


@dataclass(frozen=True)
class TemporalSplit:
    """Which quarters belong to which split. Bounded metadata: one label each."""

    quarters: tuple[str, ...]
    n_train: int
    n_validation: int
    loans: tuple[int, ...] = ()

    @property
    def train_rows(self) -> int | None:
        return sum(self.loans[: self.n_train]) if self.loans else None

    @property
    def by_split(self) -> dict[str, tuple[str, ...]]:
        a, b = self.n_train, self.n_train + self.n_validation
        return dict(zip(S.SPLITS, (self.quarters[:a], self.quarters[a:b], self.quarters[b:])))

    def label(self, quarter: Column | str = S.QUARTER) -> Column:
        """Quarter labels sort chronologically, so two comparisons place a row."""
        column = F.col(quarter) if isinstance(quarter, str) else quarter
        splits = self.by_split
        return (
            F.when(column.isNull(), None)
            .when(column <= F.lit(splits["train"][-1]), F.lit("train"))
            .when(column <= F.lit(splits["validation"][-1]), F.lit("validation"))
            .otherwise(F.lit("shift"))
        )

    def apply(self, typed: DataFrame) -> DataFrame:
        return typed.withColumn(S.SPLIT, self.label())


def plan_split(
    typed: DataFrame,
    *,
    train: float = 0.6,
    validation: float = 0.2,
    shift: float | None = None,
) -> TemporalSplit:
    check_fractions(train, validation, shift)
    counted = typed.groupBy(S.QUARTER).agg(F.count(F.lit(1)).alias("loans"))
    rows = counted.orderBy(S.QUARTER).collect()
    quarters = tuple(r[S.QUARTER] for r in rows)
    if None in quarters:
        raise DataContractError(f"{S.ISSUE_DATE!r} is required for every retained row")
    sizes = quarter_counts(len(quarters), train, validation)
    return TemporalSplit(quarters, *sizes, tuple(r["loans"] for r in rows))


def quarter_table(typed: DataFrame, *, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Lazy form: (issue_quarter, rows, q_index, dataset_split).

    The windows run over distinct quarters, a few hundred rows at most.
    """
    counted = typed.groupBy(S.QUARTER).agg(F.count(F.lit(1)).alias("loans"))
    total = F.count(F.lit(1)).over(W.partitionBy())
    index = F.row_number().over(W.orderBy(S.QUARTER))
    raw_train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train)).cast("int"))
    raw_validation = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(validation)).cast("int"))
    full = (raw_train + raw_validation == F.col("n")).cast("int")
    from_train = full * (raw_train >= raw_validation).cast("int")
    n_train = raw_train - from_train
    n_both = raw_train + raw_validation - full
    return (
        counted.select("*", total.alias("n"), index.alias("q_index"))
        .withColumn(
            S.SPLIT,
            F.when(F.col("q_index") <= n_train, "train")
            .when(F.col("q_index") <= n_both, "validation")
            .otherwise("shift"),
        )
        .select(S.QUARTER, "loans", "q_index", S.SPLIT)
    )


def split_windows(df: DataFrame) -> DataFrame:
    """Rows, quarters and date bounds per split."""
    return df.groupBy(S.SPLIT).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(S.QUARTER).alias("quarters"),
        F.min(S.QUARTER).alias("first_quarter"),
        F.max(S.QUARTER).alias("last_quarter"),
        F.min(S.ISSUE_DATE).alias("issue_date_min"),
        F.max(S.ISSUE_DATE).alias("issue_date_max"),
    )


def split_order(df: DataFrame) -> DataFrame:
    """One row telling whether train < validation < shift in time, strictly."""
    def edge(split: str, pick) -> Column:
        return pick(F.when(F.col(S.SPLIT) == split, F.col(S.ISSUE_DATE)))

    bounds = df.agg(
        edge("train", F.max).alias("train_end"),
        edge("validation", F.min).alias("validation_start"),
        edge("validation", F.max).alias("validation_end"),
        edge("shift", F.min).alias("shift_start"),
    )
    ordered = (F.col("train_end") < F.col("validation_start")) & (
        F.col("validation_end") < F.col("shift_start")
    )
    return bounds.withColumn("chronological", F.coalesce(ordered, F.lit(False)))


@dataclass(frozen=True)
class Fold:
    index: int
    train: tuple[str, ...]
    validation: tuple[str, ...]


def expanding_folds(quarters: Sequence[str], folds: int = 3) -> list[Fold]:
    """Fold i trains on all blocks before block i and validates on block i; of
    the ``folds + 1`` blocks the first ones take the spare quarters."""
    if folds < 1 or len(quarters) < folds + 1:
        raise DataContractError(f"{folds} folds need at least {folds + 1} training quarters")
    size, spare = divmod(len(quarters), folds + 1)
    edges = [0]
    for block in range(folds + 1):
        edges.append(edges[-1] + size + (block < spare))
    ordered = tuple(quarters)
    return [
        Fold(i, ordered[: edges[i]], ordered[edges[i]: edges[i + 1]]) for i in range(1, folds + 1)
    ]


def fold_table(train: DataFrame, folds: int = 3) -> DataFrame:
    """Lazy form: (fold, role, issue_quarter, loans) over distinct quarters."""
    counted = train.groupBy(S.QUARTER).agg(F.count(F.lit(1)).alias("loans"))
    ranked = counted.select(
        "*",
        (F.row_number().over(W.orderBy(S.QUARTER)) - 1).alias("i"),
        F.count(F.lit(1)).over(W.partitionBy()).cast("int").alias("n"),
    )
    blocks = folds + 1
    size, spare = F.expr(f"n div {blocks}"), F.expr(f"n % {blocks}")
    long_part = spare * (size + 1)
    block = F.when(F.col("i") < long_part, F.floor(F.col("i") / (size + 1))).otherwise(
        spare + F.floor((F.col("i") - long_part) / size)
    ).cast("int")
    return (
        ranked.withColumn("block", block)
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .filter("block <= fold")
        .select(
            "fold",
            F.when(F.col("block") < F.col("fold"), "train").otherwise("validation").alias("role"),
            S.QUARTER,
            "loans",
        )
    )
