"""Feature store to evaluated, saved models."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import adwin, models, store
from ledgerlens.operators.features import Preprocessor


def train(
    spark: SparkSession, root: str, out: str, *, config: models.TrainingConfig | None = None,
    overwrite: bool = False, factories=None,
) -> dict[str, models.Evaluation]:
    """Train every family on its view and save bundles; the primary model's
    validation scores, in time order, prime the drift detector."""
    config = config or models.TrainingConfig()
    unscaled, scaled, manifest = store.load_views(spark, root)
    names = manifest["feature_names"]
    preprocessor = Preprocessor.load(spark, f"{root}/artifacts/preprocessor")
    found: dict[str, models.Evaluation] = {}
    for name in config.candidates:
        family = models.FAMILIES[name]
        view = scaled if family.view == "scaled" else unscaled
        found[name] = models.train_and_evaluate(
            name, view, names, config=config, factories=factories)
    params = {name: e.params for name, e in found.items()}
    version = models.model_version(
        preprocessor.schema_digest, config.seed, preprocessor.training_quarters, params,
        store.content_fields(manifest))
    for name, result in found.items():
        bundle = models.ScoringModel(
            preprocessor, result.model, result.threshold, version, models.FAMILIES[name].view)
        models.save_bundle(bundle, f"{out}/{name}", overwrite=overwrite, extra={
            "parameters": result.params, "cross_validation": result.cv,
            "validation": result.validation, "shift": result.shift,
        })
    primary = models.PRIMARY if models.PRIMARY in found else next(iter(found))
    view = scaled if models.FAMILIES[primary].view == "scaled" else unscaled
    scores = models.positive_probability(
        found[primary].model, view.filter(F.col(S.SPLIT) == "validation")
    ).select(
        F.lit(version).alias("model_version"), S.ISSUE_DATE, S.LOAN_ID, "score")
    adwin.detect(scores, order=(S.ISSUE_DATE, S.LOAN_ID)).write.mode(
        "overwrite" if overwrite else "errorifexists"
    ).parquet(f"{out}/detector")
    return found
