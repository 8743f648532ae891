"""Order-dependent building blocks that stay distributed.

A plain window without a partition key, or with one hot key, sends an unbounded
number of rows to one task. The helpers here first shrink the rows (distinct
values, histograms) and then split what is left into ranges whose offsets come
from a small aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import materialise

# One task may comfortably sort this many narrow rows.
TASK_ROWS = 1_000_000
RANGES = 256
STEP = 16
# Bins of a bracket: so many short rows a column reach the driver.
BINS = 1024


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key. Spark turns ``row_number <= 1`` into a group limit
    that runs before the shuffle, so a hot key ships one row per map task."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter("_position = 1").drop("_position")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, str],
    *,
    descending: bool = False,
    range_keys: Sequence[str] = (),
    task_rows: int = TASK_ROWS,
    ranges: int = RANGES,
) -> DataFrame:
    """Cumulative sums over ``value`` per ``keys``.

    ``df`` holds one row per (keys, value); ``sums`` maps input column to output
    column. Up to ``task_rows`` distinct values a key is one window; beyond, each
    key is cut into value ranges. ``range_keys`` names the keys (bounded in
    number) whose value domains differ enough to need range bounds of their own.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    grid = [i / ranges for i in range(1, ranges)]
    bounds = (
        df.groupBy(*range_keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx(value, grid, 10_000).alias("_bounds"),
        )
        .collect()
    )
    if max((row["_n"] for row in bounds), default=0) <= task_rows:
        running = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.select(
            "*", *[F.sum(source).over(running).alias(name) for source, name in sums.items()]
        )

    if range_keys:
        fields = [df.schema[k] for k in range_keys]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        cuts = {
            tuple(row[k] for k in range_keys): sorted(set(map(float, row["_bounds"])))
            for row in bounds
        }
        table = df.sparkSession.createDataFrame(
            [(*key, values, values[STEP - 1::STEP]) for key, values in cuts.items()],
            schema + ", _bounds array<double>, _coarse array<double>",
        )
        # One row per range key, ``ranges`` numbers each: bounded, so broadcast.
        placed = df.join(F.broadcast(table), list(range_keys))
    else:
        values = sorted(set(map(float, bounds[0]["_bounds"])))
        placed = df.withColumn("_bounds", F.lit(values).cast("array<double>")).withColumn(
            "_coarse", F.lit(values[STEP - 1::STEP]).cast("array<double>"))
    # Two short searches instead of one over all bounds: whole steps below the value
    # first, then inside the step that holds it.
    target = F.col(value).cast("double")
    steps = placed.withColumn("_steps", F.size(F.filter("_coarse", lambda b: b < target)) * STEP)
    inside_step = F.slice("_bounds", F.col("_steps") + 1, F.lit(STEP))
    below = F.col("_steps") + F.size(F.filter(inside_step, lambda b: b < target))
    placed = steps.withColumn("_range", -below if descending else below).drop(
        "_bounds", "_coarse", "_steps")

    totals = placed.groupBy(*keys, "_range").agg(
        *[F.sum(source).alias(f"_t_{name}") for source, name in sums.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_offset_range"),
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name in sums.values()
        ],
    )
    inside = (
        W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    )
    local = placed.select(
        "*", *[F.sum(source).over(inside).alias(name) for source, name in sums.items()]
    )
    same = F.col("_range") == F.col("_offset_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(offsets, same, "inner")
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.col(f"_o_{name}")).alias(name) for name in sums.values()],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
) -> DataFrame:
    """Row numbers (from 1) per ``keys`` in ``order``, safe for one hot key.

    Rows are range-partitioned on keys and order and written to the checkpoint
    folder, so a hot key spans many partitions and partition ids stay fixed.
    ``order`` must identify a row within its key.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(slices, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_offset_part"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order))
    local = placed.withColumn("_local", inside)
    same = F.col("_part") == F.col("_offset_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, same).select(
        *df.columns, (F.col("_local") + F.col("_offset")).alias(name)
    )


@dataclass
class _Search:
    """Search for one order statistic: the value with ``rank`` smaller ones."""

    column: str
    rank: int
    total: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0

    def contains(self) -> Column:
        value = F.col(self.column).cast("double")
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value >= F.lit(self.low))
        if self.high is not None:
            test = test & (value <= F.lit(self.high))
        return test

    def pinned(self) -> bool:
        return self.low is not None and self.low == self.high

    def done(self, task_rows: int) -> bool:
        return self.pinned() or self.inside <= task_rows

    def width(self) -> float | None:
        """Between the bounds, where bins can be told apart in it."""
        if self.low is None or self.high is None:
            return None
        width = self.high - self.low
        return width if math.isfinite(width) and width > 0 and BINS / width < math.inf else None


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    *,
    task_rows: int = TASK_ROWS,
    row_bound: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated percentiles of several columns, nulls skipped.

    Spark's ``percentile`` is exact but keeps every distinct value of a column in
    one buffer. It is used while the columns hold at most ``task_rows`` values
    (``row_bound`` may state that up front); beyond, histograms, or approximate
    percentiles where values crowd in one bin, bracket each needed rank until few
    enough values are left to sort.
    """
    columns = list(columns)
    if row_bound is None or row_bound > task_rows:
        row = df.agg(*[
            f(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(columns)
            for name, f in (("n", F.count), ("low", F.min), ("high", F.max))
        ]).first()
        totals = {c: row[f"n_{i}"] for i, c in enumerate(columns)}
        edges = {c: (row[f"low_{i}"], row[f"high_{i}"]) for i, c in enumerate(columns)}
    else:
        totals = {c: row_bound for c in columns}
    if max(totals.values(), default=0) <= task_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(
            *[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in columns]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities)
                for c in columns}

    needed: dict[tuple[str, int], _Search] = {}
    for c in columns:
        for p in probabilities:
            position = (totals[c] - 1) * p
            for rank in {math.floor(position), math.ceil(position)}:
                if totals[c]:
                    needed[c, rank] = _Search(c, rank, totals[c], *edges[c], inside=totals[c])
    _narrow(df, list(needed.values()), task_rows)
    values = _pick(df, list(needed.values()))

    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in probabilities:
            if not totals[c]:
                result[c].append(None)
                continue
            position = (totals[c] - 1) * p
            low, high = math.floor(position), math.ceil(position)
            first, last = values[c, low], values[c, high]
            result[c].append(first + (last - first) * (position - low))
    return result


def _brackets(searches: Sequence[_Search]) -> dict[tuple, list[_Search]]:
    """Searches by the values they still look at: both middle ranks of a median share theirs."""
    found: dict[tuple, list[_Search]] = {}
    for s in searches:
        found.setdefault((s.column, s.low, s.high), []).append(s)
    return found


def _narrow(df: DataFrame, searches: list[_Search], task_rows: int) -> None:
    """Shrink every bracket to ``task_rows`` values or to one repeated value."""
    crowded: set[int] = set()
    margin = 0.0005
    while True:
        active = [s for s in searches if not s.done(task_rows)]
        if not active:
            return
        even = [s for s in active if id(s) not in crowded and s.width() is not None]
        before = {id(s): s.inside for s in even}
        if even:
            _by_histogram(df, even)
            # Outliers leave nearly all values in one bin: ranks tell those apart.
            crowded |= {id(s) for s in even if s.inside > before[id(s)] / 4}
        rest = [s for s in active if id(s) not in before]
        if rest and not _by_estimate(df, rest, margin):
            margin *= 0.5


def _hits(df: DataFrame, groups: Mapping[tuple, list[_Search]], fields) -> DataFrame:
    """One row per row and bracket that holds its value: (bracket, *fields(search))."""
    entries = [
        F.when(group[0].contains(), F.struct(F.lit(i).alias("bracket"), *fields(group[0])))
        for i, group in enumerate(groups.values())
    ]
    return df.select(F.explode(F.array(*entries)).alias("hit")).filter(
        F.col("hit").isNotNull()).select("hit.*")


def _by_histogram(df: DataFrame, searches: list[_Search]) -> None:
    """Shrink every bracket to the bin of its rank. Bins rise with the values, and each
    knows its least and greatest one, so a bin of one repeated value ends its search."""
    groups = _brackets(searches)

    def binned(s: _Search) -> list[Column]:
        value = F.col(s.column).cast("double")
        place = F.floor((value - F.lit(s.low)) * F.lit(BINS / s.width())).cast("int")
        return [value.alias("value"), place.alias("bin")]

    bins = _hits(df, groups, binned).groupBy("bracket", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    by_bracket: dict[int, list] = {}
    for row in sorted(bins.collect(), key=lambda r: (r["bracket"], r["bin"])):
        by_bracket.setdefault(row["bracket"], []).append(row)
    for i, group in enumerate(groups.values()):
        for s in group:
            below = s.below
            for row in by_bracket[i]:
                if below <= s.rank < below + row["n"]:
                    s.low, s.high, s.below, s.inside = row["low"], row["high"], below, row["n"]
                    break
                below += row["n"]


def _by_estimate(df: DataFrame, active: list[_Search], margin: float) -> bool:
    """Shrink brackets by approximate percentiles, proven by counts; whether all shrank."""
    brackets = df.agg(*[
        F.percentile_approx(
            F.when(s.contains(), F.col(s.column).cast("double")),
            [
                max(0.0, (s.rank - s.below) / s.inside - margin),
                min(1.0, (s.rank - s.below) / s.inside + margin),
            ],
            10_000,
        ).alias(f"b{i}")
        for i, s in enumerate(active)
    ]).first()
    counts = []
    for i, s in enumerate(active):
        low, high = brackets[f"b{i}"]
        value = F.col(s.column).cast("double")
        counts += [
            F.count_if(value < F.lit(low)).alias(f"l{i}"),
            F.count_if(value <= F.lit(high)).alias(f"h{i}"),
        ]
    found = df.agg(*counts).first()
    shrunk = True
    for i, s in enumerate(active):
        low, high = brackets[f"b{i}"]
        below, upto = found[f"l{i}"], found[f"h{i}"]
        before = (s.low, s.high, s.inside)
        if below <= s.rank < upto:
            s.low, s.high, s.below, s.inside = low, high, below, upto - below
        elif s.rank < below:  # the estimate missed: keep the proven side
            s.high, s.inside = math.nextafter(low, -math.inf), below - s.below
        else:
            s.inside = s.inside - (upto - s.below)
            s.low, s.below = math.nextafter(high, math.inf), upto
        shrunk = shrunk and (s.low, s.high, s.inside) != before
    return shrunk


def _pick(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    # A search that ended at one repeated value has its answer.
    found = {(s.column, s.rank): s.low + 0.0 for s in searches if s.pinned()}
    left = [s for s in searches if not s.pinned()]
    if not left:
        return found
    groups = _brackets(left)
    inside = _hits(df, groups, lambda s: [F.col(s.column).cast("double").alias("value")])
    counted = inside.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(
        W.partitionBy("bracket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    )
    wanted = F.array(*[
        F.array(*[
            F.struct(F.lit(left.index(s)).alias("search"), F.lit(s.rank - s.below).alias("rank"))
            for s in group
        ])
        for group in groups.values()
    ])
    rows = (
        counted.withColumn("_upto", upto)
        .select("value", "_upto", F.explode(F.element_at(wanted, F.col("bracket") + 1)).alias("s"))
        .filter(F.col("_upto") > F.col("s.rank"))
        .groupBy("s.search")
        .agg(F.min("value").alias("value"))
        .collect()
    )
    return found | {
        (left[r["search"]].column, left[r["search"]].rank): r["value"] for r in rows}


def smallest_hashes(
    df: DataFrame, digest: Column, tie: str, count: int, *, task_rows: int = 10_000
) -> Column | None:
    """Predicate for the ``count`` rows with the smallest (digest, tie).

    ``digest`` is a 64-bit hash. Each pass histograms 16 of its bits to find the
    slice that holds the boundary, so nothing is sorted but the last few rows.
    Returns None when no row is to be taken.
    """
    if count <= 0:
        return None
    hashed = df.select(digest.alias("_h"), F.col(tie).alias("_tie"))
    low, remaining = -(2 ** 63), count
    current = hashed
    for shift in (48, 32, 16, 0):
        steps = (
            current.groupBy(F.shiftright("_h", shift).alias("_step"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn(
                "_upto",
                F.sum("_n").over(W.orderBy("_step").rowsBetween(W.unboundedPreceding, 0)),
            )
            .filter(F.col("_upto") >= remaining)
            .orderBy("_step")
            .limit(1)
            .first()
        )
        if steps is None:
            return F.lit(True)
        remaining -= steps["_upto"] - steps["_n"]
        low, high = steps["_step"] << shift, ((steps["_step"] + 1) << shift) - 1
        current = hashed.filter(F.col("_h").between(low, high))
        if steps["_n"] <= task_rows:
            break
    last = (
        current.orderBy("_h", "_tie").limit(remaining)
        .agg(F.max(F.struct("_h", "_tie")).alias("m")).first()["m"]
    )
    return (digest < F.lit(last["_h"])) | (
        (digest == F.lit(last["_h"])) & (F.col(tie) <= F.lit(last["_tie"]))
    )
