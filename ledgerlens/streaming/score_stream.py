"""Structured Streaming: score monitoring and continuous scoring."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens import schema as S
from ledgerlens.functions import derive
from ledgerlens.operators import adwin, attributions, drift
from ledgerlens.operators.features import type_columns
from ledgerlens.operators.models import ScoringModel, positive_probability, score_raw


def latest_check(spark: SparkSession, path: str | None) -> int:
    """How many features the newest stored check found drifted, 0 where there is none. A
    check stays in force until the next."""
    if path is None:
        return 0
    newest = spark.read.parquet(path).orderBy(F.col("created_at").desc()).select(
        "feature_drift_count").first()
    return newest[0] if newest else 0


def _observe(scores: DataFrame, batch_id: int, sink: str, states: str,
             primed: DataFrame | None, feature_checks: str | None) -> None:
    """Walk one trigger's scores on from the states of the trigger before; write the new
    states and the snapshots, each to the trigger's own folder."""
    spark = scores.sparkSession
    before = spark.read.parquet(f"{states}/batch={batch_id - 1}") if batch_id else primed
    events = adwin.walk(scores, initial=before).persist()
    events.filter("final").drop("at", "fresh", "final").write.mode("overwrite").parquet(
        f"{states}/batch={batch_id}")
    shown = events.filter("fresh > 0 AND NOT (final AND adwin_change_detected)")
    checked = F.lit(latest_check(spark, feature_checks)).cast("long")
    shown.select(
        "model_version", "score_stream_count", "latest_score", "adwin_change_detected",
        "detections", F.col("at").alias("updated_at"), checked.alias("feature_drift_count"),
        drift.drift_status(
            F.col("adwin_change_detected"), checked, F.col("score_stream_count")).alias("status"),
    ).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    events.unpersist()


def run_monitor(
    scores: DataFrame, sink: str, checkpoint: str, *, primed: DataFrame | None = None,
    feature_checks: str | None = None, **trigger: Any,
) -> StreamingQuery:
    """Snapshots from a score stream (prediction_id, model_version, score, created_at):
    one at each detected change and one per model and trigger, appended to a Parquet
    table. Drains what is there by default.

    Each trigger's scores are walked from the states that the trigger before has stored
    beside the checkpoint; ``primed`` has the states before the first, as training writes
    them. A trigger that is run again starts from the same states and overwrites its own
    output. ``feature_checks`` is a table of feature checks (created_at,
    feature_drift_count); every trigger takes the newest one there is.
    """
    def observe(batch: DataFrame, batch_id: int) -> None:
        _observe(batch, batch_id, sink, f"{checkpoint}-states", primed, feature_checks)

    return (
        scores.writeStream.foreachBatch(observe)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def explained(raw: DataFrame, model: ScoringModel, at: str) -> DataFrame:
    """Raw applications to predictions as the review desk stores them: score, flag, study
    arm, leading features and narrative, the latter two withheld from the score-only arm.

    An application's id and the model version make its prediction id, so that a replayed
    application gives the same row."""
    kept = ("_at",)
    typed = type_columns(raw.withColumn("_at", F.col(at).cast("timestamp")), keep=kept)
    view = model.preprocessor.transform(typed, kept)
    if model.view == "scaled":
        view = model.preprocessor.scale(view, kept)
    scored = positive_probability(model.model, view)
    names = model.preprocessor.feature_names
    if model.view == "scaled":
        rows = attributions.linear_attributions(scored, model.model, names)
    else:
        rows = attributions.tree_attributions(
            scored, model.model, names, keep=(S.LOAN_ID, "_at", "score"))
    rows = attributions.narrate(rows)
    rows = rows.select(
        F.sha2(F.concat_ws("|", F.col(S.LOAN_ID).cast("string"), F.lit(model.version)), 256)
        .alias("prediction_id"),
        S.LOAN_ID, F.lit(model.version).alias("model_version"), "score",
        derive.risk_flag("score", model.threshold).alias("risk_flag"),
        F.col("_at").alias("created_at"), "top_features", "narrative",
        F.lit(True).alias("explanation_available"))
    rows = rows.withColumn("study_arm", derive.study_arm(F.col("prediction_id")))
    return attributions.mask_explanation(rows, "study_arm")


def run_desk(
    applications: DataFrame, model: ScoringModel, sink: str, checkpoint: str, *, at: str,
    primed: DataFrame | None = None, feature_checks: str | None = None, **trigger: Any,
) -> StreamingQuery:
    """The whole scoring flow over an application stream: every trigger writes its explained
    predictions to ``{sink}/predictions``, then takes their scores, in the order of column
    ``at``, into the detector and writes ``{sink}/snapshots``. Every output has a folder for
    each trigger, which a replayed trigger overwrites; the detector's states lie beside the
    checkpoint."""
    def take(batch: DataFrame, batch_id: int) -> None:
        predictions = f"{sink}/predictions/batch={batch_id}"
        explained(batch, model, at).write.mode("overwrite").parquet(predictions)
        written = batch.sparkSession.read.parquet(predictions)
        _observe(written, batch_id, f"{sink}/snapshots", f"{checkpoint}-states", primed,
                 feature_checks)

    return (
        applications.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_scoring(
    applications: DataFrame, model: ScoringModel, sink: str, checkpoint: str, **trigger: Any
) -> StreamingQuery:
    """Score an application stream with the fitted preprocessor and model. Scoring
    is a projection, so the same code serves batch and stream; each micro-batch
    lands in its own folder, which makes a replayed batch overwrite itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score_raw(batch, model).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        applications.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
