"""Queries over scores: metrics, thresholds, drift tests, training, streams."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import derive
from ledgerlens.operators import adwin, attributions, drift, metrics, models
from ledgerlens.plans.inputs import Inputs, rounded
from ledgerlens.plans.registry import Registry
from ledgerlens.plans.review_queries import snapshots_with_results
from ledgerlens.session import materialise, scratch

QUERIES = Registry()
query = QUERIES.add
THRESHOLD = 0.5093


def _points(by: str = "") -> str:
    return f"""
  SELECT {by} count(*) AS row_count, count(*) FILTER (target = 1) AS positive_count,
    count(*) FILTER (target = 0) AS negative_count,
    count(*) FILTER (target = 0 AND score < {THRESHOLD}) AS true_negative,
    count(*) FILTER (target = 0 AND score >= {THRESHOLD}) AS false_positive,
    count(*) FILTER (target = 1 AND score < {THRESHOLD}) AS false_negative,
    count(*) FILTER (target = 1 AND score >= {THRESHOLD}) AS true_positive,
    avg((score - target) * (score - target)) AS brier FROM graded_by"""


_RATES = """
  round((true_positive + true_negative) / row_count, 6) AS accuracy,
  round(CASE WHEN true_positive + false_positive = 0 THEN 0.0
    ELSE true_positive / (true_positive + false_positive) END, 6) AS precision,
  round(CASE WHEN true_positive + false_negative = 0 THEN 0.0
    ELSE true_positive / (true_positive + false_negative) END, 6) AS recall,
  round(CASE WHEN 2 * true_positive + false_positive + false_negative = 0 THEN 0.0
    ELSE 2 * true_positive / (2 * true_positive + false_positive + false_negative) END, 6) AS f1,
  round(brier, 6) AS brier"""
_COUNTS = ("row_count", "positive_count", "negative_count", "true_negative", "false_positive",
           "false_negative", "true_positive")
_COUNT_SQL = ", ".join(_COUNTS)
_RATE_NAMES = ("accuracy", "precision", "recall", "f1", "brier")


@query("metrics_at_threshold", f"""
SELECT {_COUNT_SQL}, {_RATES} FROM ({_points().replace('graded_by', 'graded')})""")
def metrics_at_threshold(x: Inputs) -> DataFrame:
    return metrics.at_threshold(x.graded(), THRESHOLD).select(*_COUNTS, *rounded(*_RATE_NAMES))


@query("score_curve", """
SELECT score, positives, negatives, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve""")
def score_curve(x: Inputs) -> DataFrame:
    return metrics.score_curve(x.graded())


@query("roc_auc", """
SELECT count(*) FILTER (target = 1) AS positive_count, count(*) FILTER (target = 0) AS negative_count,
  round((sum(CASE WHEN target = 1 THEN r ELSE 0 END)
    - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0)
    / (CAST(count(*) FILTER (target = 1) AS DOUBLE) * count(*) FILTER (target = 0)), 6) AS roc_auc
FROM (SELECT target, rank() OVER (ORDER BY score)
  + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM graded)""")
def roc_auc(x: Inputs) -> DataFrame:
    curve = metrics.score_curve(x.graded())
    return metrics.ranking_metrics(curve).select(
        "positive_count", "negative_count", *rounded("roc_auc"))


@query("average_precision", """
SELECT round(sum(CAST(positives AS DOUBLE) * tp / (tp + fp)) / sum(positives), 6) AS pr_auc
FROM curve""")
def average_precision(x: Inputs) -> DataFrame:
    return metrics.ranking_metrics(metrics.score_curve(x.graded())).select(*rounded("pr_auc"))


@query("score_ks", """
SELECT round(greatest(max(tp / p - fp / n), 0.0), 6) AS ks FROM (
  SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp,
    (SELECT sum(positives) FROM curve) AS p, (SELECT sum(negatives) FROM curve) AS n FROM curve)""")
def score_ks(x: Inputs) -> DataFrame:
    return metrics.score_ks(metrics.score_curve(x.graded())).select(*rounded("ks"))


def _grouped_sql(by: str, keys: str, extra: str) -> str:
    """Metrics per group; ``extra`` adds the group columns to graded predictions."""
    return f"""
WITH graded_by AS (SELECT *, {extra} FROM graded),
points AS ({_points(by + ',')} GROUP BY {by}),
by_score AS (SELECT {by}, score, CAST(count(*) FILTER (target = 1) AS DOUBLE) AS positives,
  CAST(count(*) FILTER (target = 0) AS DOUBLE) AS negatives FROM graded_by GROUP BY {by}, score),
curves AS (SELECT *, sum(positives) OVER w AS tp, sum(negatives) OVER w AS fp,
  sum(positives) OVER (PARTITION BY {by}) AS p, sum(negatives) OVER (PARTITION BY {by}) AS n
  FROM by_score WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
ranked AS (SELECT {by}, sum(positives * (n - fp + negatives / 2)) / max(p * n) AS roc_auc,
  sum(positives * tp / (tp + fp)) / max(p) AS pr_auc, greatest(max(tp / p - fp / n), 0.0) AS ks
  FROM curves WHERE p > 0 AND n > 0 GROUP BY {by})
SELECT {keys}, {_COUNT_SQL}, {_RATES}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
  round(ks, 6) AS ks FROM points LEFT JOIN ranked USING ({by})"""


@query("metrics_by_quarter", _grouped_sql(
    "issue_quarter", "issue_quarter",
    "CAST(year(created_at) AS VARCHAR) || 'Q' || CAST(quarter(created_at) AS VARCHAR) AS issue_quarter"))
def metrics_by_quarter(x: Inputs) -> DataFrame:
    graded = x.graded().withColumn(S.QUARTER, derive.quarter_label("created_at"))
    return metrics.evaluate(graded, THRESHOLD, by=[S.QUARTER]).select(
        S.QUARTER, *_COUNTS, *rounded(*_RATE_NAMES, "roc_auc", "pr_auc", "ks"))


@query("f1_threshold", """
WITH candidates AS (SELECT score AS threshold,
  2.0 * tp / (tp + fp + (SELECT sum(positives) FROM curve)) AS f1 FROM curve)
SELECT threshold, round(f1, 6) AS f1 FROM candidates
WHERE abs(f1 - (SELECT max(f1) FROM candidates)) <= 1e-8 + 1e-5 * (SELECT max(f1) FROM candidates)
ORDER BY abs(threshold - 0.5), threshold LIMIT 1""")
def f1_threshold(x: Inputs) -> DataFrame:
    return metrics.f1_threshold(x.graded()).select("threshold", *rounded("f1"))


_CV_SQL = _grouped_sql(
    "candidate, fold", "candidate, fold",
    "CAST(requested_by_id % 4 AS BIGINT) AS candidate, CAST(year(created_at) % 3 AS BIGINT) AS fold",
).replace("round(", "(").replace(", 6)", ")")


@query("cv_select", f"""
SELECT candidate, round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc,
  round(avg(f1), 6) AS f1, round(avg(ks), 6) AS ks, round(avg(brier), 6) AS brier,
  round(avg(accuracy), 6) AS accuracy
FROM ({_CV_SQL}) m GROUP BY candidate
ORDER BY avg(m.roc_auc) DESC, avg(m.pr_auc) DESC, avg(m.f1) DESC, candidate LIMIT 1""")
def cv_select(x: Inputs) -> DataFrame:
    """Candidates are officers' groups, folds are years modulo three."""
    graded = x.graded().withColumn(
        "candidate", (F.col("requested_by_id") % 4).cast("long")
    ).withColumn("fold", (F.year("created_at") % 3).cast("long"))
    folds = metrics.evaluate(graded, THRESHOLD, by=["candidate", "fold"])
    return metrics.select_candidate(folds).select("candidate", *rounded(*metrics.CV_METRICS))


@query("comparable_columns", """
SELECT feature, count(*) FILTER (is_reference) AS reference_count,
  count(*) FILTER (NOT is_reference) AS current_count FROM cohort_stack GROUP BY feature""")
def comparable_columns(x: Inputs) -> DataFrame:
    """Cohorts that also carry dates, a target and a column with one number only."""
    reference, current = x.cohorts()
    sparse = F.when(F.col("prediction_id") == 1, "1").otherwise("none")
    return drift.comparable_columns(
        reference.withColumn("sparse", sparse), current.withColumn("sparse", sparse))


@query("ks_statistic", """
WITH totals AS (SELECT feature, count(*) FILTER (is_reference) AS reference_count,
  count(*) FILTER (NOT is_reference) AS current_count FROM cohort_stack GROUP BY feature),
steps AS (SELECT feature, value, count(*) FILTER (is_reference) AS r,
  count(*) FILTER (NOT is_reference) AS c FROM cohort_stack GROUP BY feature, value),
running AS (SELECT feature, CAST(sum(r) OVER w AS DOUBLE) AS below_r,
  CAST(sum(c) OVER w AS DOUBLE) AS below_c FROM steps
  WINDOW w AS (PARTITION BY feature ORDER BY value))
SELECT feature, round(max(abs(below_r / reference_count - below_c / current_count)), 6) AS statistic,
  any_value(reference_count) AS reference_count, any_value(current_count) AS current_count
FROM running JOIN totals USING (feature) GROUP BY feature""")
def ks_statistic(x: Inputs) -> DataFrame:
    return drift.ks_statistics(*x.cohorts()).select(
        "feature", *rounded("statistic"), "reference_count", "current_count")


@query("ks_drift")
def ks_drift(x: Inputs) -> DataFrame:
    return drift.ks_drift(*x.cohorts())


@query("adwin_scores")
def adwin_scores(x: Inputs) -> DataFrame:
    return adwin.detect(x.view("score_stream")).drop(
        "bucket_counts", "bucket_means", "bucket_squares")


@query("replay_state")
def replay_state(x: Inputs) -> DataFrame:
    return adwin.replay_state(x.view("predictions"), snapshots_with_results(x)).drop(
        "feature_results")


def _training_view(x: Inputs, family: str) -> tuple[DataFrame, models.Preprocessor]:
    labelled, preprocessor = x.fitted()
    view = preprocessor.transform(labelled)
    if models.FAMILIES[family].view == "scaled":
        view = preprocessor.scale(view)
    return view, preprocessor


# One fit per application, tables and family, with the library's settings: several queries
# look at the same model.
_FITS: dict[tuple[str, str, str], tuple[models.Preprocessor, models.PipelineModel]] = {}


def _trained(x: Inputs, family: str):
    key = (x.spark.sparkContext.applicationId, x.sf_dir, family)
    if key not in _FITS:
        view, preprocessor = _training_view(x, family)
        train = materialise(view.filter(F.col(S.SPLIT) == "train").select(
            S.TARGET, *preprocessor.feature_names), "train")
        _FITS[key] = (preprocessor, models.fit_family(family, train, preprocessor.feature_names))
        return view, *_FITS[key]
    preprocessor, model = _FITS[key]
    view = preprocessor.transform(x.stored())
    if models.FAMILIES[family].view == "scaled":
        view = preprocessor.scale(view)
    return view, preprocessor, model


def _scored(view: DataFrame, model: models.PipelineModel) -> DataFrame:
    return materialise(
        models.positive_probability(model, view).select(S.SPLIT, S.TARGET, "score"))


def _quality(x: Inputs, family: str) -> DataFrame:
    view, _, model = _trained(x, family)
    return metrics.evaluate(_scored(view, model), 0.5, by=[S.SPLIT])


@query("train_gbt")
def train_gbt(x: Inputs) -> DataFrame:
    return _quality(x, "boosted_trees")


@query("train_rf")
def train_rf(x: Inputs) -> DataFrame:
    return _quality(x, "random_forest")


@query("train_lr")
def train_lr(x: Inputs) -> DataFrame:
    return _quality(x, "logistic_regression")


def _every_family(x: Inputs, work: Callable) -> list:
    """``work(family, view, preprocessor)`` of all default families, at a time: the small
    steps of one family's fits leave room for another's."""
    families = list(models.TrainingConfig().candidates)
    views = [_training_view(x, family) for family in families]
    with ThreadPoolExecutor(len(families)) as pool:
        return list(pool.map(work, families, *zip(*views)))


@query("temporal_cv")
def temporal_cv(x: Inputs) -> DataFrame:
    """Every family and candidate of the default settings, by fold."""
    config = models.TrainingConfig()

    def validate(family: str, view: DataFrame, preprocessor: models.Preprocessor) -> DataFrame:
        return models.cross_validate(
            family, view.filter(F.col(S.SPLIT) == "train"), preprocessor.feature_names,
            config=config).withColumn("family", F.lit(family))

    return functools.reduce(DataFrame.unionByName, _every_family(x, validate))


@query("train_evaluate")
def train_evaluate(x: Inputs) -> DataFrame:
    """Every family of the default settings, selected, fitted and measured."""
    config = models.TrainingConfig()
    columns = ("row_count", "true_positive", "true_negative", "false_positive", "false_negative",
               *metrics.CV_METRICS)

    def measure(family: str, view: DataFrame, preprocessor: models.Preprocessor) -> list[tuple]:
        found = models.train_and_evaluate(
            family, view, preprocessor.feature_names, config=config)
        return [(family, split, found.threshold, *[getattr(found, split)[c] for c in columns])
                for split in ("validation", "shift")]

    rows = [row for family in _every_family(x, measure) for row in family]
    kinds = ", ".join(f"{c} {'bigint' if i < 5 else 'double'}" for i, c in enumerate(columns))
    return x.spark.createDataFrame(
        rows, f"family string, dataset_split string, threshold double, {kinds}")


def _bundle(x: Inputs, family: str = "boosted_trees") -> models.ScoringModel:
    """The fitted model with the threshold that is best on validation."""
    view, preprocessor, model = _trained(x, family)
    validation = _scored(view.filter(F.col(S.SPLIT) == "validation"), model)
    threshold = metrics.f1_threshold(validation).first()["threshold"]
    version = models.model_version(
        preprocessor.schema_digest, models.SEED, preprocessor.training_quarters, {})
    return models.ScoringModel(
        preprocessor, model, threshold, version, models.FAMILIES[family].view)


@query("score_batch")
def score_batch(x: Inputs) -> DataFrame:
    """Every loan, resolved or not, through preprocessor, model and threshold."""
    return models.score_raw(x.loans(), _bundle(x))


@query("linear_attributions")
def linear_attributions(x: Inputs) -> DataFrame:
    view, preprocessor, model = _trained(x, "logistic_regression")
    explained = attributions.linear_attributions(view, model, preprocessor.feature_names)
    return explained.select(
        "loan_id", F.aggregate("attributions", F.lit(0.0), lambda s, e: s + e["contribution"])
        .alias("total_contribution"))


@query("tree_attributions")
def tree_attributions(x: Inputs) -> DataFrame:
    view, preprocessor, model = _trained(x, "boosted_trees")
    explained = attributions.tree_attributions(view, model, preprocessor.feature_names)
    return explained.select(
        "loan_id", "base_value",
        F.aggregate("attributions", F.lit(0.0), lambda s, e: s + e["contribution"])
        .alias("total_contribution"))


@query("top_attributions")
def top_attributions(x: Inputs) -> DataFrame:
    view, preprocessor, model = _trained(x, "logistic_regression")
    explained = attributions.linear_attributions(view, model, preprocessor.feature_names)
    return attributions.narrate(explained).select(
        "loan_id", F.explode("top_features").alias("t"), "narrative"
    ).select("loan_id", "t.feature", "t.display_name", "t.direction", "t.contribution", "narrative")


@query("stream_adwin")
def stream_adwin(x: Inputs) -> DataFrame:
    """The score stream through Structured Streaming, in two files per trigger."""
    from ledgerlens.streaming import score_stream

    source, sink = scratch(x.spark, "scores"), scratch(x.spark, "snapshots")
    scores = x.view("score_stream").withColumn("created_at", F.col("created_at").cast("timestamp"))
    scores.repartitionByRange(4, "created_at").write.parquet(source)
    stream = x.spark.readStream.schema(scores.schema).option(
        "maxFilesPerTrigger", 2).parquet(source)
    score_stream.run_monitor(stream, sink, scratch(x.spark, "monitor")).awaitTermination()
    return x.spark.read.parquet(sink).drop("batch")


@query("stream_desk")
def stream_desk(x: Inputs) -> DataFrame:
    """Raw loans as a stream of applications: explained predictions, read back."""
    from ledgerlens.streaming import score_stream

    bundle = _bundle(x, "logistic_regression")
    source, sink = scratch(x.spark, "applications"), scratch(x.spark, "desk")
    raw = x.loans().withColumn("received_at", F.timestamp_seconds(F.col("loan_id").cast("long")))
    raw.repartition(4).write.parquet(source)
    stream = x.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(source)
    score_stream.run_desk(
        stream, bundle, sink, scratch(x.spark, "desk-state"), at="received_at").awaitTermination()
    return x.spark.read.parquet(f"{sink}/predictions").select(
        "prediction_id", "loan_id", "risk_flag", "study_arm", "explanation_available", "narrative",
        F.size("top_features").alias("n_top_features"))


@query("stream_scoring")
def stream_scoring(x: Inputs) -> DataFrame:
    """Raw loans as a stream, scored with the fitted bundle."""
    from ledgerlens.streaming import score_stream

    bundle = _bundle(x, "logistic_regression")
    source, sink = scratch(x.spark, "applications"), scratch(x.spark, "scored")
    raw = x.loans()
    raw.repartition(4).write.parquet(source)
    stream = x.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(source)
    score_stream.run_scoring(stream, bundle, sink, scratch(x.spark, "scoring")).awaitTermination()
    return x.spark.read.parquet(sink).drop("batch").select("loan_id", "score", "risk_flag",
                                                           "model_version")
