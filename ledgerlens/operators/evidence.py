"""What written files prove: order-free digests per quarter, and time zones per file.

A digest of rows is a sum of row hashes, so it depends neither on the order of the rows nor
on how they are dealt into files, and counts copies. Every task sums its own rows and one
short row per file and task is shuffled, never the rows themselves. Two hashes of 64 bits
per row are summed in pieces of 21 and 22 bits: a long holds the sum of 2**41 of them.

The digests find changed rows, not forged ones: the hashes are not cryptographic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators.windows import TimeWindow

LANE_BITS = 21
LANES = tuple(f"lane_{k}" for k in range(6))


def _lanes(columns: Sequence[str]) -> list[Column]:
    """Pieces of two row hashes. A null leaves Spark's hash as it was, so every cell is
    hashed with whether it is null; columns go by name, not by place."""
    cells = [cell for c in sorted(columns) for cell in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    piece = F.lit((1 << LANE_BITS) - 1).cast("long")
    lanes = []
    for row_hash in (F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)):
        lanes += [row_hash.bitwiseAND(piece),
                  F.shiftright(row_hash, LANE_BITS).bitwiseAND(piece),
                  F.shiftrightunsigned(row_hash, 2 * LANE_BITS)]
    return lanes


def _sums(columns: Sequence[str]) -> list[Column]:
    return [F.sum(lane).alias(name) for name, lane in zip(LANES, _lanes(columns))]


def _digest() -> Column:
    """One text for the sums of a group."""
    return F.sha2(F.concat_ws(":", *[F.sum(c).cast("string") for c in LANES]), 256)


def content_digests(view: DataFrame, *keys: str) -> DataFrame:
    """(keys..., rows, digest) of any table; two tables hold the same multiset of rows under
    a key when the digests agree. Without keys one row covers all; an empty table has no row."""
    groups = [F.col(k) for k in keys]
    sums = view.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *_sums(view.columns))
    return sums.groupBy(*groups).agg(
        F.sum("rows").alias("rows"), _digest().alias("digest")).filter("rows > 0")


def file_name() -> Column:
    """A file by its folder and name, as a task gives all files it writes the same name. It
    depends on the file alone, so Spark drops files by it before it opens them."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def file_facts(spark: SparkSession, path: str, time: str = S.ISSUE_DATE) -> DataFrame:
    """One row per file of a view written by quarter: rows, missing times, least and greatest
    time, and the sums behind the digests."""
    view = spark.read.parquet(path)
    named = view.withColumn(S.QUARTER, F.col(S.QUARTER).cast("string")).select(
        "*", file_name().alias("_file"))
    return named.groupBy(S.QUARTER, F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(time).isNull()).alias("missing_times"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *_sums(view.columns),
    )


def quarter_digests(facts: DataFrame) -> DataFrame:
    """(quarter, rows, digest) from the facts of files; equal to the digests of the rows."""
    return facts.groupBy(S.QUARTER).agg(F.sum("rows").alias("rows"), _digest().alias("digest"))


def as_mapping(digests: DataFrame) -> dict[str, str]:
    """One short text per quarter."""
    return {r[S.QUARTER]: f"{r['rows']}:{r['digest']}" for r in digests.collect()}


def differing(left: dict[str, str], right: dict[str, str]) -> list[str]:
    """Quarters whose rows differ, or that only one side has."""
    return sorted((q for q in left.keys() | right.keys() if left.get(q) != right.get(q)),
                  key=lambda q: (q is None, q))


def outside(facts: DataFrame, window: TimeWindow) -> DataFrame:
    """Files in the window's quarters that hold no row of the window: those that partition
    pruning leaves in although they can be skipped, so files of the first and last quarter."""
    test = F.lit(False)
    if window.start is not None:
        bound = F.lit(window.start)
        test = test | (F.col("last_time") < bound if window.include_start
                       else F.col("last_time") <= bound)
    if window.end is not None:
        bound = F.lit(window.end)
        test = test | (F.col("first_time") > bound if window.include_end
                       else F.col("first_time") >= bound)
    return facts.filter(window.partition_predicate() & test).select("file")
