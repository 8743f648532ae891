"""How often queries repeat their steps."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import features, models
from ledgerlens.plans import model_queries
from ledgerlens.plans.inputs import Inputs

SMOKE = "/root/testdata/sf0.001"


def test_rows_are_parsed_once_and_families_run_together(spark, monkeypatch):
    counted, met = {"fit": 0, "typed": 0}, threading.Barrier(3)
    fit, typed = features.fit, Inputs.typed

    def counted_fit(*args, **options):
        counted["fit"] += 1
        return fit(*args, **options)

    def counted_typed(self):
        counted["typed"] += 1
        return typed(self)

    def together(name, view, names, *, config):
        met.wait(30)  # broken unless every family is at it
        row = dict.fromkeys(("row_count", "true_positive", "true_negative", "false_positive",
                             "false_negative"), 1) | dict.fromkeys(models.metrics.CV_METRICS, 0.5)
        return models.Evaluation(name, None, {}, 0.5, [], row, row)

    monkeypatch.setattr(features, "fit", counted_fit)
    monkeypatch.setattr(Inputs, "typed", counted_typed)
    monkeypatch.setattr(models, "train_and_evaluate", together)
    assert model_queries.train_evaluate(Inputs(spark, SMOKE)).count() == 6
    assert counted == {"fit": 1, "typed": 1}

    model_queries._bundle(Inputs(spark, SMOKE), "logistic_regression")
    counted["typed"] = 0
    model_queries._bundle(Inputs(spark, SMOKE), "logistic_regression")  # the fit is known
    assert counted["typed"] == 1


def test_a_single_candidate_is_fitted_beside_its_folds(spark, monkeypatch):
    met, fits = threading.Barrier(4), models.fit_family

    def meeting(name, train, names, params=None, **options):
        met.wait(60)  # three folds and the last fit
        return fits(name, train, names, params, **options)

    x = Inputs(spark, SMOKE)
    labelled, preprocessor = x.fitted()
    view = preprocessor.transform(labelled)
    config = models.TrainingConfig(candidates={"random_forest": ({"numTrees": 2},)})
    names = preprocessor.feature_names
    monkeypatch.setattr(models, "fit_family", meeting)
    found = models.train_and_evaluate("random_forest", view, names, config=config)
    monkeypatch.undo()
    train = view.filter(F.col(S.SPLIT) == "train").select(S.QUARTER, S.TARGET, *names)
    assert len(found.cv) == 3 and found.params == {"numTrees": 2}
    again = models.cross_validate("random_forest", train, names, config=config).collect()
    assert [r["roc_auc"] for r in again] == pytest.approx([r["roc_auc"] for r in found.cv])
