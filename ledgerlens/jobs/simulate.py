"""Window, perturb and audit: a reproducible drift simulation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import perturb, store
from ledgerlens.operators.windows import TimeWindow
from ledgerlens.session import materialise

DEFAULT_SEED = 20260926


@dataclass(frozen=True)
class Simulation:
    frame: DataFrame
    report: DataFrame
    summary: dict

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Rows at ``path``, per-shift report and manifest beside it."""
        self.frame.write.mode(mode).parquet(path)
        self.report.coalesce(1).write.mode(mode).json(f"{path}.report")
        text = json.dumps(self.summary, sort_keys=True, default=str)
        self.frame.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(
            mode
        ).text(f"{path}.manifest")


def simulate(
    spark: SparkSession, path: str, *, window: TimeWindow | None = None,
    shifts: Sequence[perturb.Shift] = (), seed: int = DEFAULT_SEED,
    time_column: str = S.ISSUE_DATE, view: str = "unscaled", row_id: str = S.LOAN_ID,
) -> Simulation:
    """The window is written once to the shared folder, since counting, selecting
    and summarising each pass over it."""
    window = window or TimeWindow()
    read = store.read_window(spark, path, window, time_column=time_column, view=view)
    rows = materialise(read.frame)
    protected = [c for c in (S.TARGET, S.ISSUE_DATE, S.QUARTER, S.SPLIT) if c in rows.columns]
    if shifts:
        frame, report = perturb.perturb_with_report(
            rows, shifts, seed=seed, row_id=row_id, protected=protected)
    else:
        frame, report = rows, spark.createDataFrame([], "operation int, feature string")
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows_selected"),
        F.min(time_column).alias("selected_time_min"),
        F.max(time_column).alias("selected_time_max"),
    ).first().asDict()
    return Simulation(frame, report, {
        "schema_version": "1.0",
        "seed": seed,
        "source": read.source,
        "feature_view": read.view,
        "time_column": time_column,
        "target_column": S.TARGET,
        "metadata_columns": protected,
        "window": window.as_dict(),
        "shifts": [vars(s) for s in shifts],
        **facts,
    })
