"""Derived feature columns and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.parse import as_column

SECONDS_PER_YEAR = S.DAYS_PER_YEAR * 24 * 3600


def positive(value: Column | str) -> Column:
    column = as_column(value)
    return F.when(column > 0, column)


def loan_to_income(amount: Column | str, income: Column | str) -> Column:
    return as_column(amount) / positive(income)


def installment_to_income(installment: Column | str, income: Column | str) -> Column:
    return as_column(installment) / (positive(income) / F.lit(12.0))


def credit_history_years(issued: Column | str, earliest: Column | str) -> Column:
    micros = F.unix_micros(as_column(issued)) - F.unix_micros(as_column(earliest))
    years = micros / F.lit(1e6) / F.lit(SECONDS_PER_YEAR)
    return F.when(years >= 0, years)


def quarter_label(date: Column | str) -> Column:
    """``2018Q1``; labels sort chronologically as text."""
    column = as_column(date)
    return F.concat(
        F.lpad(F.year(column).cast("string"), 4, "0"), F.lit("Q"), F.quarter(column).cast("string")
    )


def month_label(date: Column | str) -> Column:
    return F.date_format(as_column(date), "yyyy-MM")


def risk_flag(score: Column | str, threshold: float) -> Column:
    return as_column(score) >= F.lit(float(threshold))


def study_arm(identity: Column | str) -> Column:
    """A stable, roughly even arm from the parity of the identity's digest."""
    first_byte = F.conv(F.substring(F.sha2(as_column(identity).cast("string"), 256), 1, 2), 16, 10)
    return F.when(first_byte.cast("int") % 2 == 0, F.lit(S.ARM_SHOWN)).otherwise(
        F.lit(S.ARM_SCORE_ONLY)
    )


def display_name(feature: Column | str) -> Column:
    column = as_column(feature)
    names = F.create_map(*[F.lit(x) for pair in S.DISPLAY_NAMES.items() for x in pair])
    generic = F.replace(
        F.replace(column, F.lit(S.MISSING_FLAG_SUFFIX), F.lit(" missingness")),
        F.lit("_"), F.lit(" "),
    )
    return F.coalesce(F.try_element_at(names, column), generic)


def score_bin(score: Column | str, bins: int = 10) -> Column:
    column = as_column(score)
    return F.when(column >= 1.0, F.lit(bins - 1)).otherwise(
        F.floor(column * bins).cast("int")
    ).cast("long")
