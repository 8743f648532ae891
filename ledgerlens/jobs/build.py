"""Raw loan CSVs to a feature store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens import schema as S
from ledgerlens.operators import features, outcomes, splits, store
from ledgerlens.session import materialise
from ledgerlens.sources import loans


def with_loan_id(raw: DataFrame) -> DataFrame:
    """Files without an id column get one from each row's content, and from its number
    among equal rows: the same rows get the same ids, however files are named or split."""
    if S.LOAN_ID in raw.columns:
        return raw
    content = F.xxhash64(*[F.col(c) for c in sorted(raw.columns)])
    equal = Window.partitionBy("_content").orderBy(*sorted(raw.columns))
    numbered = raw.withColumn("_content", content).withColumn(
        "_number", F.row_number().over(equal))
    return numbered.withColumn(S.LOAN_ID, F.when(F.col("_number") == 1, F.col("_content"))
                               .otherwise(F.xxhash64("_content", "_number"))
                               ).drop("_content", "_number")


def build(
    spark: SparkSession, paths: Sequence[str], root: str, *, train_fraction: float = 0.6,
    validation_fraction: float = 0.2, shift_fraction: float | None = None,
    overwrite: bool = False, multi_line: bool | None = None, seed: int = 20260926,
) -> dict:
    """Scan, resolve, split by quarter, fit on train, write both views.

    The CSV is parsed once, after one pass for quotes: its rows go to the shared folder, and
    checks, ids and typed rows start from there.
    """
    scanned = loans.require_sound(materialise(
        loans.scan_loans(spark, paths, multi_line=multi_line, keep=(S.LOAN_ID,)), "scanned"))
    raw = outcomes.select_allowed(with_loan_id(scanned))
    outcomes.require_resolved(raw)
    resolved = outcomes.resolve(raw)
    features.require_parsable(resolved)
    typed = materialise(features.type_columns(resolved))
    plan = splits.plan_split(
        typed, train=train_fraction, validation=validation_fraction, shift=shift_fraction)
    labelled = plan.apply(typed)
    train = labelled.filter(F.col(S.SPLIT) == "train")
    preprocessor = features.fit(
        train, row_bound=plan.train_rows, quarters=plan.by_split["train"])
    # A dirty status column has any number of values: the inventory is a table of its own.
    statuses = materialise(outcomes.status_inventory(raw), "statuses")
    return store.write_store(
        labelled, preprocessor, root, overwrite=overwrite, raw=resolved.drop(S.TARGET),
        statuses=statuses,
        extra={
            "random_seed": seed,
            "split": {k: list(v) for k, v in plan.by_split.items()},
            "statuses": statuses.count(),
            "sources": sorted(p.rsplit("/", 1)[-1] for p in paths),
        },
    )
