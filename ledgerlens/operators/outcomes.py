"""Column allow-list, outcome resolution and outcome aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import derive, parse


def select_allowed(
    df: DataFrame, *, require_target: bool = True, keep: Sequence[str] = (S.LOAN_ID,)
) -> DataFrame:
    """Keep contract columns only, in one canonical order for every source."""
    required = S.ALLOWED if require_target else S.PREDICTORS
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataContractError(f"missing required columns: {missing}")
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, *sorted(c for c in S.ALLOWED if c in df.columns))


def ignored_columns(df: DataFrame) -> list[str]:
    """Post-origination columns that the allow-list leaves behind."""
    return sorted(set(df.columns) & set(S.POST_ORIGINATION))


def refuse_leakage(feature_names: Sequence[str]) -> None:
    banned = {*S.POST_ORIGINATION, S.STATUS, S.ISSUE_DATE, S.EARLIEST_CREDIT}
    found = sorted(set(feature_names) & banned)
    if found:
        raise DataContractError(f"columns that may not reach the feature matrix: {found}")


def normal_status(status: Column | str = S.STATUS) -> Column:
    return F.lower(parse.strip(status))


def outcome(status: Column | str = S.STATUS) -> Column:
    text = normal_status(status)
    return (
        F.when(text.isin(*S.DEFAULTED), F.lit(1))
        .when(text.isin(*S.REPAID), F.lit(0))
        .cast("byte")
    )


def resolve(df: DataFrame) -> DataFrame:
    """Rows with a known outcome, as ``target``; every other status is dropped."""
    return df.withColumn(S.TARGET, outcome()).filter(F.col(S.TARGET).isNotNull())


def require_resolved(df: DataFrame) -> None:
    if resolve(df).isEmpty():
        seen = [r[0] for r in df.select(normal_status()).distinct().limit(10).collect()]
        raise DataContractError(f"no resolved outcomes; observed statuses include {seen}")


def status_inventory(df: DataFrame) -> DataFrame:
    return df.groupBy(
        F.coalesce(normal_status(), F.lit("<missing>")).alias("status")
    ).agg(F.count(F.lit(1)).alias("loans"))


def class_balance(df: DataFrame) -> DataFrame:
    """Count and share per class; one aggregate row unpivoted into two."""
    totals = resolve(df).agg(
        F.count_if(F.col(S.TARGET) == 0).alias("repaid"),
        F.count_if(F.col(S.TARGET) == 1).alias("defaulted"),
    )
    share = F.col("loans") / F.nullif(F.col("repaid") + F.col("defaulted"), F.lit(0))
    return totals.select(
        "*", F.explode(F.array(
            F.struct(F.lit(0).alias("target"), F.lit("Fully Paid").alias("class_label"),
                     F.col("repaid").alias("loans")),
            F.struct(F.lit(1).alias("target"), F.lit("Default or Charged Off").alias("class_label"),
                     F.col("defaulted").alias("loans")),
        )).alias("c")
    ).select("c.*", "repaid", "defaulted").select("target", "class_label", "loans", share.alias("share"))


def quarterly_composition(df: DataFrame) -> DataFrame:
    """Resolved loans, defaults and default rate per quarter. Rows whose date
    cannot be read are kept out of the quarters and counted in a null quarter."""
    return (
        resolve(df)
        .select(S.TARGET, derive.quarter_label(parse.parse_date(S.ISSUE_DATE)).alias(S.QUARTER))
        .groupBy(S.QUARTER)
        .agg(
            F.count(F.lit(1)).alias("resolved_loans"),
            F.sum(F.col(S.TARGET).cast("long")).alias("defaults"),
        )
        .withColumn("default_rate", F.col("defaults") / F.col("resolved_loans"))
    )
