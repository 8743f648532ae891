"""Null rates before imputation and the run's data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import parse
from ledgerlens.operators import outcomes
from ledgerlens.operators.features import Preprocessor

COLUMNS = (
    "feature_name string, dtype string, source_column string, null_rate double, "
    "transformation_applied string, leakage_risk_flag boolean"
)
# Dictionary texts.
DERIVED_SOURCES = {
    "loan_to_income": "loan_amnt|annual_inc",
    "installment_to_income": "installment|annual_inc",
    "credit_history_years": "earliest_cr_line|issue_d",
}
NUMERIC_TEXTS = {
    "term": "parse term to months; training-median imputation",
    "int_rate": "strip optional percent sign; numeric coercion; training-median imputation",
    "revol_util": "strip optional percent sign; numeric coercion; training-median imputation",
    "emp_length": "parse employment length to years; training-median imputation",
    "loan_to_income": "safe divide loan_amnt by positive annual_inc; training-median imputation",
    "installment_to_income":
        "safe divide installment by positive monthly income; training-median imputation",
    "credit_history_years":
        "derive year fraction from earliest_cr_line to issue_d; training-median imputation",
}
DEFAULT_NUMERIC_TEXT = "numeric coercion; training-median imputation"
ORDINAL_TEXT = "fixed target-independent ordinal mapping; unknown category sentinel -1"
ONE_HOT_TEXT = "one-hot category learned on training window; unknown categories ignored"
METADATA_TEXTS = (
    ("target", "int8", "loan_status",
     "map Charged Off or Default to 1 and Fully Paid to 0; exclude unresolved outcomes"),
    ("issue_d", "datetime64[ns]", "issue_d",
     "parse issue month; derive partition quarter; exclude from model matrix"),
    ("earliest_cr_line", "datetime64[ns]", "earliest_cr_line",
     "derive credit_history_years; exclude raw date from model matrix"),
)
EXCLUDED_TEXT = "excluded post-origination field"


def raw_null_rates(raw: DataFrame) -> DataFrame:
    """(column_name, null_rate) of raw text columns over resolved rows."""
    names = [c for c in raw.columns if c in S.ALLOWED or c in S.POST_ORIGINATION]
    rates = outcomes.resolve(raw).agg(*[
        F.avg(F.when(parse.is_missing(c), 1.0).otherwise(0.0)).alias(c) for c in names
    ])
    return _long(rates, names)


def feature_null_rates(typed: DataFrame) -> DataFrame:
    """(column_name, null_rate) of the typed numeric features."""
    rates = typed.agg(*[
        F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in S.NUMERIC
    ])
    return _long(rates, S.NUMERIC)


def _long(row: DataFrame, names) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in names
    ])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def _described(preprocessor: Preprocessor) -> list[tuple]:
    """(feature, dtype, source, text, flag, rate kind, rate columns)."""
    rows: list[tuple] = []
    for name in S.NUMERIC:
        rows.append((name, "float64", DERIVED_SOURCES.get(name, name),
                     NUMERIC_TEXTS.get(name, DEFAULT_NUMERIC_TEXT), False, "feature", name))
    for name in S.NUMERIC:
        rows.append((S.missing_flag(name), "int8", DERIVED_SOURCES.get(name, name),
                     f"1 when {name} is missing or undefined before imputation",
                     False, "feature", name))
    for name in S.ORDINALS:
        rows.append((name, "int16", name, ORDINAL_TEXT, False, "raw", name))
    for name, (column, _) in preprocessor.one_hot_names.items():
        rows.append((name, "float64", column, ONE_HOT_TEXT, False, "raw", column))
    for name, dtype, source, text in METADATA_TEXTS:
        rows.append((name, dtype, source, text, True, "raw", source))
    for name in S.POST_ORIGINATION:
        rows.append((name, "excluded", name, EXCLUDED_TEXT, True, "raw", name))
    return rows


def data_dictionary(
    raw: DataFrame, typed: DataFrame, preprocessor: Preprocessor
) -> DataFrame:
    """Features with null rates before imputation, then target and dates, then the
    deny-list. Ratios use typed nulls; text columns use raw missing tokens."""
    spark = raw.sparkSession
    rates = raw_null_rates(raw).withColumn("kind", F.lit("raw")).unionByName(
        feature_null_rates(typed).withColumn("kind", F.lit("feature"))
    )
    described = spark.createDataFrame(
        _described(preprocessor),
        "feature_name string, dtype string, source_column string, "
        "transformation_applied string, leakage_risk_flag boolean, kind string, "
        "column_name string",
    )
    return described.join(F.broadcast(rates), ["kind", "column_name"], "left").select(
        "feature_name", "dtype", "source_column", "null_rate",
        "transformation_applied", "leakage_risk_flag",
    )
