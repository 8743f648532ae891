"""Which rows the queries over a fitted model score."""

from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import metrics, models
from ledgerlens.plans import model_queries
from ledgerlens.plans.inputs import Inputs


def test_the_threshold_scores_validation_rows_only(spark, monkeypatch):
    x, family = Inputs(spark, "/root/testdata/sf0.001"), "logistic_regression"
    view, _, model = model_queries._trained(x, family)
    whole = model_queries._scored(view, model)
    best = metrics.f1_threshold(whole.filter(F.col(S.SPLIT) == "validation")).first()
    splits, score = [], models.positive_probability

    def scored(model, frame):
        splits.append({r[0] for r in frame.select(S.SPLIT).distinct().collect()})
        return score(model, frame)

    monkeypatch.setattr(models, "positive_probability", scored)
    assert model_queries._bundle(x, family).threshold == best["threshold"]
    assert splits == [{"validation"}]
