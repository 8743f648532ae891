"""Raw loans to typed features, and the fitted projection to model features."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import derive, parse
from ledgerlens.operators import outcomes
from ledgerlens.operators.ranking import TASK_ROWS, exact_percentiles


def present_texts(df: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Every parsed field as present text: the first projections of the parse. Spark
    keeps them apart from the next one, because that reads each text more than once."""
    def each(text) -> list[Column]:
        return [F.col(c) if c in S.ORDINALS else text(c).alias(c) for c in S.PREDICTORS]

    stripped = df.select(*kept, *each(parse.strip)).select(*kept, *each(parse.present_of))
    return stripped.withColumn("emp_length", parse.emp_length_text("emp_length"))


def type_columns(df: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Parse every raw field and derive ratios, history, quarter and categories.

    Three narrow projections: clean texts, then values, then what depends on them.
    """
    kept = [c for c in (S.LOAN_ID, S.TARGET, *keep) if c in df.columns]
    typed = present_texts(df, kept).select(
        *kept,
        parse.date_from(S.ISSUE_DATE).alias(S.ISSUE_DATE),
        parse.date_from(S.EARLIEST_CREDIT).alias("_earliest"),
        *[reader(name).alias(name) for name, reader in parse.READERS.items()],
        parse.grade_ordinal("grade").alias("grade"),
        parse.sub_grade_ordinal("sub_grade").alias("sub_grade"),
        *[parse.category_from(c, c).alias(c) for c in S.CATEGORIES],
    )
    # The digits-only reading yields no NaN, so one comparison removes overflow.
    infinity = F.lit(float("inf"))
    finite = typed.select(*[
        F.nullif(F.col(c), infinity).alias(c) if c in S.RAW_NUMERIC else F.col(c)
        for c in typed.columns
    ])
    return finite.select(
        *kept,
        S.ISSUE_DATE,
        derive.quarter_label(S.ISSUE_DATE).alias(S.QUARTER),
        *S.RAW_NUMERIC,
        parse.finite_or_null(
            derive.loan_to_income("loan_amnt", "annual_inc")).alias("loan_to_income"),
        parse.finite_or_null(
            derive.installment_to_income("installment", "annual_inc")
        ).alias("installment_to_income"),
        derive.credit_history_years(S.ISSUE_DATE, "_earliest").alias("credit_history_years"),
        *S.ORDINALS,
        *S.CATEGORIES,
    )


def bad_value_counts(df: DataFrame) -> DataFrame:
    """One row: unparsable values per field, plus rows without an issue date."""
    texts = present_texts(df)
    readers = {**parse.READERS, S.ISSUE_DATE: parse.date_from, S.EARLIEST_CREDIT: parse.date_from}

    def bad(name: str) -> Column:
        value = readers[name](name)
        if name in parse.READERS:
            value = F.nullif(value, F.lit(float("inf")))
        return F.col(name).isNotNull() & value.isNull()

    return texts.agg(
        *[F.count_if(bad(name)).alias(name) for name in readers],
        F.count_if(F.col(S.ISSUE_DATE).isNull()).alias("issue_d_missing"),
    )


def require_parsable(df: DataFrame) -> None:
    """Raise with up to five distinct examples of the first bad field."""
    counts = bad_value_counts(df).first().asDict()
    if counts.pop("issue_d_missing"):
        raise DataContractError(f"{S.ISSUE_DATE!r} is required for every retained row")
    for name, bad in counts.items():
        if bad:
            parser = parse.PARSERS.get(name, parse.parse_date)
            rows = df.filter(parse.unparsable(name, parser)).select(name).distinct().limit(5)
            raise DataContractError(
                f"{bad} values of {name!r} cannot be read, e.g. {[r[0] for r in rows.collect()]}"
            )


@dataclass(frozen=True)
class Preprocessor:
    """State learned on training rows only; applied as literals."""

    medians: dict[str, float]
    vocabulary: dict[str, list[str]]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    training_rows: int = 0
    training_quarters: list[str] = field(default_factory=list)
    schema_version: str = S.SCHEMA_VERSION

    @property
    def one_hot_names(self) -> dict[str, tuple[str, str]]:
        return {
            f"{column}_{value}": (column, value)
            for column in S.CATEGORIES
            for value in self.vocabulary[column]
        }

    @property
    def feature_names(self) -> list[str]:
        names = [
            *S.NUMERIC, *[S.missing_flag(c) for c in S.NUMERIC], *S.ORDINALS, *self.one_hot_names,
        ]
        if len(set(names)) != len(names):
            raise DataContractError("duplicate transformed feature names")
        outcomes.refuse_leakage(names)
        return names

    @property
    def schema_digest(self) -> str:
        return hashlib.sha256("\n".join(self.feature_names).encode()).hexdigest()

    def feature_columns(self) -> list[Column]:
        return [
            *[impute(c, self.medians[c]).alias(c) for c in S.NUMERIC],
            *[missing_indicator(c).alias(S.missing_flag(c)) for c in S.NUMERIC],
            *[F.col(c).alias(c) for c in S.ORDINALS],
            *[one_hot(c, v).alias(n) for n, (c, v) in self.one_hot_names.items()],
        ]

    def transform(self, typed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The unscaled view: metadata and kept columns, then features in fitted order."""
        return typed.select(*self._metadata(typed), *keep, *self.feature_columns())

    def scale(self, unscaled: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The scaled view of rows already transformed."""
        return unscaled.select(
            *self._metadata(unscaled), *keep,
            *[
                scale(name, self.means[name], self.scales[name]).alias(name)
                for name in self.feature_names
            ],
        )

    @staticmethod
    def _metadata(df: DataFrame) -> list[str]:
        known = (S.LOAN_ID, S.ISSUE_DATE, S.QUARTER, S.SPLIT, S.TARGET)
        return [c for c in known if c in df.columns]

    def matches(self, other: Preprocessor) -> bool:
        """Equal, except that means and scales may differ in their last digits: the
        order in which a cluster adds doubles is not fixed. Medians are exact."""
        def close(a: dict[str, float], b: dict[str, float]) -> bool:
            return a.keys() == b.keys() and all(
                math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a
            )

        return (
            replace(self, means={}, scales={}) == replace(other, means={}, scales={})
            and close(self.means, other.means) and close(self.scales, other.scales)
        )

    def to_json(self) -> str:
        payload = {**asdict(self), "feature_names": self.feature_names,
                   "feature_schema_sha256": self.schema_digest}
        return json.dumps(payload, sort_keys=True, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        payload = json.loads(text)
        if payload.get("schema_version") != S.SCHEMA_VERSION:
            raise DataContractError("preprocessor was saved under another schema version")
        names = payload.pop("feature_names")
        digest = payload.pop("feature_schema_sha256")
        loaded = cls(**payload)
        if loaded.feature_names != names or loaded.schema_digest != digest:
            raise DataContractError("saved feature names do not match their digest")
        return loaded

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        frame = spark.createDataFrame([(self.to_json(),)], "value string")
        frame.coalesce(1).write.mode(mode).text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        return cls.from_json(spark.read.text(path).first()["value"])


def impute(column: str, median: float) -> Column:
    return F.coalesce(F.col(column), F.lit(float(median)))


def missing_indicator(column: str) -> Column:
    return F.col(column).isNull().cast("byte")


def one_hot(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(F.lit(value)).cast("double")


def scale(column: str, mean: float, deviation: float) -> Column:
    return (F.col(column).cast("double") - F.lit(float(mean))) / F.lit(float(deviation))


def vocabulary_rows(typed: DataFrame) -> DataFrame:
    """Distinct categories per category column, as (column_name, category)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in S.CATEGORIES
    ])
    return typed.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def fit_vocabulary(typed: DataFrame, limit: int | None = None) -> dict[str, list[str]]:
    """Sorted vocabulary per column. Each value becomes a feature column; a caller that
    wants no more than ``limit`` of them per column gets an error instead."""
    rows = vocabulary_rows(typed)
    if limit is not None:
        rows = rows.limit(limit * len(S.CATEGORIES) + 1)
    found: dict[str, list[str]] = {c: [] for c in S.CATEGORIES}
    for row in rows.collect():
        found[row["column_name"]].append(row["category"])
    for column, values in found.items():
        if limit is not None and len(values) > limit:
            raise DataContractError(f"{column!r} has more than {limit} training categories")
    return {column: sorted(values) for column, values in found.items()}


def fit_medians(
    typed: DataFrame, *, row_bound: int | None = None, task_rows: int = TASK_ROWS
) -> dict[str, float]:
    found = exact_percentiles(typed, S.NUMERIC, [0.5], row_bound=row_bound, task_rows=task_rows)
    empty = [c for c, values in found.items() if values[0] is None]
    if empty:
        raise DataContractError(f"training features without any value: {empty}")
    return {c: float(values[0]) for c, values in found.items()}


def scaler_aggregates(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation per feature (1 when constant)."""
    columns = []
    for name in names:
        value = F.col(name).cast("double")
        deviation = F.stddev_pop(value)
        columns.append(F.avg(value).alias(f"mean_{name}"))
        columns.append(F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"scale_{name}"))
    return features.agg(F.count(F.lit(1)).alias("rows"), *columns)


def fit(
    train: DataFrame, *, row_bound: int | None = None, quarters: Sequence[str] | None = None
) -> Preprocessor:
    """Fit on typed training rows: medians and vocabulary, then the scaler over
    the imputed features (it must see what it will later scale). A split plan knows
    the row bound and the quarters; without one they are looked up."""
    partial = Preprocessor(fit_medians(train, row_bound=row_bound), fit_vocabulary(train))
    names = partial.feature_names
    row = scaler_aggregates(
        train.select(S.QUARTER, *partial.feature_columns()), names
    ).first()
    if quarters is None:
        quarters = [r[0] for r in train.select(S.QUARTER).distinct().orderBy(S.QUARTER).collect()]
    return Preprocessor(
        medians=partial.medians,
        vocabulary=partial.vocabulary,
        means={n: row[f"mean_{n}"] for n in names},
        scales={n: row[f"scale_{n}"] for n in names},
        training_rows=row["rows"],
        training_quarters=list(quarters),
    )
