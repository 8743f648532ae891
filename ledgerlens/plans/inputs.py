"""Frames that several registered queries start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import features, outcomes, splits, store
from ledgerlens.operators.features import Preprocessor
from ledgerlens.plans import binding
from ledgerlens.session import materialise, scratch

COHORT_CUT = "1999-01-01"


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    plan: splits.TemporalSplit | None = None
    _stored: DataFrame | None = None
    _fitted: tuple[DataFrame, Preprocessor] | None = None

    def view(self, name: str) -> DataFrame:
        return binding.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return binding.table(self.spark, self.sf_dir, name)

    def loans(self) -> DataFrame:
        return self.view("loans_raw")

    def typed(self) -> DataFrame:
        return features.type_columns(outcomes.resolve(self.loans()))

    def split(self, *, stored: bool = False) -> DataFrame:
        """Typed rows with their split. ``stored`` writes the typed rows once to the
        shared folder, for callers that pass over them several times."""
        typed = self.typed()
        if stored:
            typed = materialise(typed)
        self.plan = splits.plan_split(typed)
        return self.plan.apply(typed)

    def stored(self) -> DataFrame:
        """Typed rows with their split, parsed and stored once for all steps of a query."""
        if self._stored is None:
            self._stored = self.split(stored=True)
        return self._stored

    def fitted(self) -> tuple[DataFrame, Preprocessor]:
        """Stored rows, and the preprocessor fitted once on those for training."""
        labelled = self.stored()
        if self._fitted is None:
            self._fitted = labelled, features.fit(
                labelled.filter(F.col(S.SPLIT) == "train"),
                row_bound=self.plan.train_rows, quarters=self.plan.by_split["train"])
        return self._fitted

    def views(self) -> tuple[DataFrame, DataFrame, Preprocessor]:
        labelled, preprocessor = self.fitted()
        unscaled = preprocessor.transform(labelled)
        return unscaled, preprocessor.scale(unscaled), preprocessor

    def written_store(self) -> str:
        labelled, preprocessor = self.fitted()
        root = scratch(self.spark, "store")
        store.write_store(labelled, preprocessor, root)
        return root

    def graded(self) -> DataFrame:
        return self.view("predictions").filter(F.col("target").isNotNull())

    def cohorts(self) -> tuple[DataFrame, DataFrame]:
        """Predictions with order values, before and from the cut."""
        both = self.view("predictions").join(
            self.table("orders").select(
                F.col("o_orderkey").alias("prediction_id"), "o_totalprice"
            ),
            "prediction_id",
        ).select("prediction_id", "score", "o_totalprice", "target", "created_at")
        cut = F.lit(COHORT_CUT).cast("timestamp_ntz")
        return both.filter(F.col("created_at") < cut), both.filter(F.col("created_at") >= cut)


def longs(*names: str) -> list:
    """Integer columns widened to bigint under their own names."""
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str, digits: int = 6) -> list:
    """Doubles rounded for comparison; adding zero folds negative zero."""
    return [(F.round(F.col(n).cast("double"), digits) + F.lit(0.0)).alias(n) for n in names]


def text_time(name: str):
    return F.date_format(F.col(name).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(name)


def unpivot(row: DataFrame, names: dict[str, str] | list[str], label: str, value: str) -> DataFrame:
    """A one-row aggregate as (label, value) rows."""
    pairs = names.items() if isinstance(names, dict) else [(n, n) for n in names]
    entries = F.array(*[
        F.struct(F.lit(shown).alias(label), F.col(column).alias(value)) for column, shown in pairs
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")
