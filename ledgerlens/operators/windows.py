"""Half-open time windows as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError


def _utc(value: str | date | datetime | None) -> datetime | None:
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


@dataclass(frozen=True)
class TimeWindow:
    """``[start, end)`` in UTC by default; each bound is optional."""

    start: str | date | datetime | None = None
    end: str | date | datetime | None = None
    include_start: bool = True
    include_end: bool = False

    def __post_init__(self) -> None:
        start, end = _utc(self.start), _utc(self.end)
        if start is not None and end is not None and start > end:
            raise DataContractError("window start must not be after its end")
        object.__setattr__(self, "start", start)
        object.__setattr__(self, "end", end)

    def predicate(self, time: Column | str = S.ISSUE_DATE) -> Column:
        column = F.col(time) if isinstance(time, str) else time
        test = F.lit(True)
        if self.start is not None:
            bound = F.lit(self.start)
            test = test & (column >= bound if self.include_start else column > bound)
        if self.end is not None:
            bound = F.lit(self.end)
            test = test & (column <= bound if self.include_end else column < bound)
        return test

    def partition_predicate(self, quarter: str = S.QUARTER) -> Column:
        """The quarters that can hold matching rows. Catalyst cannot derive the
        quarter from the date, so this is what prunes partition folders."""
        test = F.lit(True)
        if self.start is not None:
            test = test & (F.col(quarter) >= F.lit(_quarter(self.start)))
        if self.end is not None:
            test = test & (F.col(quarter) <= F.lit(_quarter(self.end)))
        return test

    def as_dict(self) -> dict[str, str | bool | None]:
        return {
            "start": self.start.isoformat() if self.start else None,
            "end": self.end.isoformat() if self.end else None,
            "include_start": self.include_start,
            "include_end": self.include_end,
        }


def _quarter(moment: datetime) -> str:
    return f"{moment.year:04d}Q{(moment.month - 1) // 3 + 1}"


def select_window(df: DataFrame, window: TimeWindow, time: str = S.ISSUE_DATE) -> DataFrame:
    """Rows inside the window; also prunes quarter partitions for issue dates."""
    test = window.predicate(time)
    if time == S.ISSUE_DATE and S.QUARTER in df.columns:
        test = test & window.partition_predicate()
    return df.filter(test)


def require_times(df: DataFrame, time: str = S.ISSUE_DATE) -> None:
    if time not in df.columns:
        raise DataContractError(f"time column {time!r} is missing")
    bad = df.agg(F.count_if(F.col(time).isNull()).alias("n")).first()["n"]
    if bad:
        raise DataContractError(f"time column {time!r} has {bad} missing values")
