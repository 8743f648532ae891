"""Records of CSV files whose quoted cells may hold line ends, read in splits.

Whether a line begins inside a quoted cell depends on all lines before it, but a line can do
only four things to that state: leave it, turn it over, or set it to inside or to outside.
Such steps compose, so each block of a file sums up its own lines, a small window over the
blocks carries the state from block to block, and every block then puts its lines together by
itself. Only a record across the border of two blocks needs another, tiny, grouping: there
are at most two such pieces a block. No file is read by one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A cell: quoted (with what may stand after the closing quote), or any text up to a comma that
# does not begin with a quote. A quote inside such a text is an ordinary character.
_CELL = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
#: A line that begins outside quotes and ends inside.
OPENS = rf'^(?:{_CELL},)*+"(?:[^"]|"")*+$'
#: A line that begins inside quotes and never leaves them.
STAYS = r'^(?:[^"]|"")*+$'
#: The end of the quoted cell in which a line begins, with its comma.
_CLOSING = r'^(?:[^"]|"")*+"[^,]*+,?'


def opens(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return line.rlike(OPENS)


def _after_inside(line: Column) -> Column:
    """Whether a line that begins inside quotes ends inside them."""
    return line.rlike(STAYS) | F.regexp_replace(line, _CLOSING, "").rlike(OPENS)


def _state(entry: Column, fixed: Column, turns: Column) -> Column:
    """Inside (True) or outside, from the state at the start, the last line that sets the
    state (value, turns until then) and the turns until now."""
    return F.when(fixed.isNull(), entry != (turns % 2 == 1)).otherwise(
        fixed["value"] != ((turns - fixed["turns"]) % 2 == 1))


def lines(spark: SparkSession, paths: Sequence[str], uri: Column) -> DataFrame:
    """(uri, block, line, value): text lines with their place; ``line`` orders within a block."""
    return spark.read.text(list(paths)).select(
        uri.alias("uri"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def records(source: DataFrame) -> DataFrame:
    """(uri, value) from :func:`lines`: each record once, its lines joined by line feeds.

    A quote that the file never closes makes the rest of the file one record, as it does for
    Spark's own reader of quoted line ends."""
    steps = source.withColumns({"f0": opens(F.col("value")), "f1": _after_inside(F.col("value"))})
    in_block = W.partitionBy("uri", "block").orderBy("line")
    upto = in_block.rowsBetween(W.unboundedPreceding, 0)
    fixes = F.when(F.col("f0") == F.col("f1"), F.struct(
        F.col("f0").alias("value"), F.col("turned").alias("turns")))
    walked = steps.withColumn(
        "turned", F.sum((F.col("f0") & ~F.col("f1")).cast("long")).over(upto)).withColumn(
        "fixed", F.last(fixes, ignorenulls=True).over(upto))

    # What each block does as a whole, and the state in which it begins.
    blocks = walked.groupBy("uri", "block").agg(
        F.max_by("turned", "line").alias("turned"), F.max_by("fixed", "line").alias("fixed"))
    before = W.partitionBy("uri").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summed = blocks.withColumn("turns_before", F.coalesce(F.sum("turned").over(before), F.lit(0)))
    fixed_before = F.last(F.when(F.col("fixed").isNotNull(), F.struct(
        F.col("fixed.value").alias("value"),
        (F.col("fixed.turns") + F.col("turns_before")).alias("turns"))), ignorenulls=True)
    entries = summed.withColumn("fixed_before", fixed_before.over(before)).select(
        "uri", "block", _state(F.lit(False), F.col("fixed_before"),
                               F.col("turns_before")).alias("entry"))

    after = _state(F.col("entry"), F.col("fixed"), F.col("turned"))
    placed = walked.join(entries, ["uri", "block"]).withColumn("after", after).withColumn(
        "inside", F.coalesce(F.lag("after").over(in_block), F.col("entry")))
    number = F.sum((~F.col("inside")).cast("long")).over(upto)
    pieces = placed.withColumn("record", number).groupBy("uri", "block", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))),
                                 lambda x: x["value"]), "\n").alias("value"),
        F.max_by("after", "line").alias("open"))

    whole = pieces.filter("record > 0 AND NOT open").select("uri", "value")
    # Pieces across blocks: one that begins a record stays open, one that goes on has number 0.
    torn = pieces.filter("record = 0 OR open").select("uri", "block", "record", "value")
    begun = F.sum((F.col("record") > 0).cast("long")).over(
        W.partitionBy("uri").orderBy("block", "record").rowsBetween(W.unboundedPreceding, 0))
    mended = torn.withColumn("of", begun).groupBy("uri", "of").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "record", "value"))),
        lambda x: x["value"]), "\n").alias("value"))
    return whole.unionByName(mended.select("uri", "value"))
