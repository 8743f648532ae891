"""Exact, tie-aware binary classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.errors import DataContractError
from ledgerlens.operators.ranking import TASK_ROWS, running_totals
from ledgerlens.session import materialise

CV_METRICS = ("accuracy", "roc_auc", "pr_auc", "f1", "ks", "brier")


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is zero where the denominator is."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def require_scores(df: DataFrame, score: str = "score", target: str = "target") -> None:
    value = F.col(score).cast("double")
    bad_score = value.isNull() | F.isnan(value) | (value < 0) | (value > 1)
    row = df.agg(
        F.count_if(bad_score).alias("scores"),
        F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)).alias("labels"),
        F.count_if(F.col(target) == 1).alias("positives"),
        F.count_if(F.col(target) == 0).alias("negatives"),
    ).first()
    if row["scores"] or row["labels"]:
        raise DataContractError(f"{row['scores']} invalid scores, {row['labels']} invalid labels")
    if not row["positives"] or not row["negatives"]:
        raise DataContractError("both target classes are needed")


def at_threshold(
    df: DataFrame, threshold: float, *, by: Sequence[str] = (),
    score: str = "score", target: str = "target",
) -> DataFrame:
    """Confusion counts and the metrics that need no ranking: one map-side
    combined aggregate."""
    flagged = F.col(score) >= F.lit(float(threshold))
    positive = F.col(target) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~positive & ~flagged).alias("true_negative"),
        F.count_if(~positive & flagged).alias("false_positive"),
        F.count_if(positive & ~flagged).alias("false_negative"),
        F.count_if(positive & flagged).alias("true_positive"),
        F.avg(F.pow(F.col(score) - F.col(target), F.lit(2.0))).alias("brier"),
    )
    tp, fp = F.col("true_positive"), F.col("false_positive")
    fn, tn = F.col("false_negative"), F.col("true_negative")
    return counts.select(
        *by,
        "row_count",
        (tp + fn).alias("positive_count"),
        (tn + fp).alias("negative_count"),
        "true_negative", "false_positive", "false_negative", "true_positive",
        _ratio(tp + tn, F.col("row_count")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        "brier",
    )


def score_curve(
    df: DataFrame, *, by: Sequence[str] = (), score: str = "score", target: str = "target",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per distinct score: positives and negatives there, and cumulative
    ``tp`` and ``fp`` from the highest score down. Ties share one row."""
    distinct = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("positives"),
        F.count_if(F.col(target) == 0).alias("negatives"),
    )
    return running_totals(
        distinct, list(by), "score", {"positives": "tp", "negatives": "fp"},
        descending=True, task_rows=task_rows,
    )


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (half credit for ties), average precision (step sum) and KS from a
    score curve; null where a group holds one class only."""
    n_pos, n_neg = F.sum("positives"), F.sum("negatives")
    # Negatives strictly below a score are all negatives less those at or above it:
    # sum(pos * (N - fp + neg / 2)) splits into two sums, so no totals are joined.
    won = F.sum(F.col("positives").cast("double") * (F.col("negatives") / 2 - F.col("fp")))
    all_pairs = n_pos.cast("double") * n_neg
    precision_mass = F.sum(F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    grouped = curve.groupBy(*by).agg(
        n_pos.alias("positive_count"),
        n_neg.alias("negative_count"),
        F.when(all_pairs > 0, (won + all_pairs) / all_pairs).alias("roc_auc"),
        F.when(all_pairs > 0, precision_mass / n_pos).alias("pr_auc"),
    )
    return grouped


def score_ks(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """max(TPR - FPR) over the curve, starting from zero above all scores."""
    totals = curve.groupBy(*by).agg(
        F.sum("positives").alias("_p"), F.sum("negatives").alias("_n")
    )
    gap = F.col("tp") / F.col("_p") - F.col("fp") / F.col("_n")
    if by:
        with_totals = curve.join(totals, list(by))
    else:  # a single row of totals, bounded by construction
        row = totals.first()
        with_totals = curve.withColumn("_p", F.lit(row["_p"])).withColumn("_n", F.lit(row["_n"]))
    return with_totals.filter("_p > 0 AND _n > 0").groupBy(*by).agg(
        F.greatest(F.max(gap), F.lit(0.0)).alias("ks")
    )


def evaluate(
    df: DataFrame, threshold: float, *, by: Sequence[str] = (),
    score: str = "score", target: str = "target",
) -> DataFrame:
    """All metrics per group. One-class groups keep their counts and get null
    ranking metrics."""
    keys = list(by) or ["_all"]
    frame = df if by else df.withColumn("_all", F.lit(1))
    points = at_threshold(frame, threshold, by=keys, score=score, target=target)
    # One sort serves the ranking, the KS totals and the KS gaps.
    curve = materialise(score_curve(frame, by=keys, score=score, target=target), "curve")
    ranked = ranking_metrics(curve, keys).drop("positive_count", "negative_count")
    result = points.join(ranked, keys, "left").join(score_ks(curve, keys), keys, "left")
    return result.withColumn("threshold", F.lit(float(threshold))).drop("_all")


def threshold_candidates(curve: DataFrame) -> DataFrame:
    """F1 at every distinct score, for a curve over one group."""
    total = curve.agg(F.sum("positives").alias("p")).first()["p"]
    predicted = F.col("tp") + F.col("fp")
    return curve.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("tp") * 2, predicted + F.lit(total)).alias("f1"),
    )


def f1_threshold(
    df: DataFrame, *, score: str = "score", target: str = "target", task_rows: int = TASK_ROWS
) -> DataFrame:
    """One row: the F1-optimal score; among near ties the one closest to 0.5, then
    the lower. Near means within 1e-8 + 1e-5 of the best, relative."""
    curve = score_curve(df, score=score, target=target, task_rows=task_rows)
    candidates = threshold_candidates(materialise(curve, "curve"))
    best = candidates.agg(F.max("f1").alias("b")).first()["b"]
    near = F.abs(F.col("f1") - F.lit(best)) <= F.lit(1e-8 + 1e-5 * abs(best))
    return (
        candidates.filter(near)
        .orderBy(F.abs(F.col("threshold") - 0.5), "threshold")
        .limit(1)
    )


def mean_cv_metrics(folds: DataFrame, key: str = "candidate") -> DataFrame:
    return folds.groupBy(key).agg(*[F.avg(m).alias(m) for m in CV_METRICS])


def select_candidate(folds: DataFrame, key: str = "candidate") -> DataFrame:
    """The best candidate by mean ROC-AUC, then PR-AUC, then F1, then lowest index."""
    order = [F.col(m).desc() for m in ("roc_auc", "pr_auc", "f1")]
    return mean_cv_metrics(folds, key).orderBy(*order, F.col(key)).limit(1)
