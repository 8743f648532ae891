"""Loan CSV scans with preambles, and cohort files."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import parse
from ledgerlens.operators import outcomes
from ledgerlens.sources import records
from ledgerlens.sources.digests import digests, file_uri, literal

HEADER_LINES = 100
EXTRA = "_extra"
URI = "_uri"
PROBES = 8


def input_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files behind paths, folders and globs, as the qualified URIs that
    ``_metadata.file_path`` reports, sorted."""
    if not paths:
        raise DataContractError("at least one CSV source is required")
    found = [re.sub("^file:/+", "file:///", uri)
             for path in paths for uri in spark.read.text(path).inputFiles()]
    if not found:
        raise DataContractError(f"no files in {list(paths)}")
    if len(set(found)) != len(found):
        raise DataContractError("duplicate CSV sources")
    return sorted(found)


def as_path(uri: str) -> str:
    """A file's URI as a path that readers take literally."""
    return literal(unquote(uri))


def shown(uri: str) -> str:
    """A file as users write it: local files without their scheme."""
    return unquote(urlparse(uri).path if uri.startswith("file:") else uri)


@dataclass(frozen=True)
class CsvLayout:
    """Where one file's header is and what it says."""

    uri: str
    header_line: int
    header: tuple[str, ...]

    @property
    def ignored(self) -> list[str]:
        return sorted(set(self.header) & set(S.POST_ORIGINATION))


def find_layout(
    spark: SparkSession, path: str, *, require_target: bool = True,
    required: Sequence[str] | None = None, first_lines: int = HEADER_LINES,
) -> CsvLayout:
    """Probe the first lines of one file (gzip and BOM are handled by the source)."""
    uri, = input_files(spark, [path])
    return _probe(spark, uri, set(required or _required(require_target)), first_lines)


def _required(require_target: bool) -> Sequence[str]:
    return S.ALLOWED if require_target else S.PREDICTORS


def _probe(spark: SparkSession, uri: str, required: set[str], first_lines: int) -> CsvLayout:
    lines = [r[0] for r in spark.read.text(as_path(uri)).limit(first_lines).collect()]
    for number, line in enumerate(lines):
        fields = tuple(f.strip() for f in next(csv.reader([line.lstrip("﻿")]), []))
        if required <= set(fields):
            repeated = sorted({f for f in fields if fields.count(f) > 1})
            if repeated:
                raise DataContractError(f"duplicate column names in {shown(uri)}: {repeated}")
            return CsvLayout(uri, number, fields)
    raise DataContractError(f"no header with the required columns in {shown(uri)}")


def _scan(spark: SparkSession, layouts: Sequence[CsvLayout], spanning: bool) -> DataFrame:
    """One scan over files that share a header; header and preamble rows removed.

    Column ``uri`` names the file. Where cells may hold line ends (``spanning``), lines are
    first put together to records, block by block."""
    header = layouts[0].header
    fields = [T.StructField(name, T.StringType()) for name in (*header, EXTRA)]
    paths = [as_path(layout.uri) for layout in layouts]
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": EXTRA}
    if spanning:
        shape = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in fields)
        found = records.records(records.lines(spark, paths, file_uri()))
        frame = found.filter("value != ''").select("uri", F.from_csv(
            "value", shape, options).alias("cells")).select("cells.*", F.col("uri").alias(URI))
    else:
        reader = spark.read.schema(T.StructType(fields)).options(**options)
        frame = reader.option("header", False).option("columnPruning", False).csv(
            paths).withColumn(URI, file_uri())
    is_header = F.lit(True)
    for name in header:
        is_header = is_header & F.trim(F.col(name)).eqNullSafe(F.lit(name))
    first = F.regexp_replace(F.col(header[0]), "^﻿", "")
    is_header = is_header | (
        (F.trim(first) == header[0]) & (F.trim(F.col(header[1])) == header[1])
    )
    rows = frame.filter(~F.coalesce(is_header, F.lit(False)))
    preambles = sorted({
        line for layout in layouts for line in _preamble_lines(spark, layout)
    })
    if preambles:
        # A preamble record carries one field; everything after it is absent or empty.
        rest_empty = F.lit(True)
        for name in header[1:]:
            rest_empty = rest_empty & (F.coalesce(F.col(name), F.lit("")) == "")
        known = F.trim(F.col(header[0])).isin(*preambles) & rest_empty
        rows = rows.filter(~F.coalesce(known, F.lit(False)))
    return rows


def _preamble_lines(spark: SparkSession, layout: CsvLayout) -> list[str]:
    if not layout.header_line:
        return []
    lines = spark.read.text(as_path(layout.uri)).limit(layout.header_line).collect()
    return [next(iter(next(csv.reader([r[0].lstrip("﻿")]), [""])), "").strip() for r in lines]


def require_same_header(spark: SparkSession, archive: str, extracted: str) -> int:
    """An archive and its extracted file must name the same columns; their number."""
    headers = [
        set(find_layout(spark, path, required=(S.ISSUE_DATE, S.STATUS), first_lines=10).header)
        for path in (archive, extracted)
    ]
    if headers[0] != headers[1]:
        raise DataContractError("archive and extracted headers differ")
    return len(headers[0])


def find_layouts(
    spark: SparkSession, paths: Sequence[str], *, require_target: bool = True
) -> list[CsvLayout]:
    """Probe all files, several at a time; a probe reads only a file's first lines."""
    required = set(_required(require_target))

    def probe(uri: str) -> CsvLayout:
        return _probe(spark, uri, required, HEADER_LINES)

    with ThreadPoolExecutor(PROBES) as pool:
        return list(pool.map(probe, input_files(spark, paths)))


def files_with_open_quotes(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Files (as URIs) in which some line leaves a quoted cell open. Only there can a
    record span lines; in all other files every line is a record."""
    rows = (
        spark.read.text(list(paths)).filter(records.opens(F.col("value")))
        .select(file_uri().alias("uri")).distinct().collect()
    )
    return {row["uri"] for row in rows}


def scan_loans(
    spark: SparkSession, paths: Sequence[str], *, require_target: bool = True,
    multi_line: bool | None = None, with_source: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Read loan CSVs through the allow-list; text columns, missing tokens nulled.
    A path may be relative, a folder or a glob.

    Records that span lines cost a shuffle of their file, so by default (None) a pass
    first finds the files that have any; True or False skips that pass. Both ways of
    reading split files of any size. Files with one header share one scan. Over-long rows
    are an error
    (:func:`require_sound`).
    """
    layouts = find_layouts(spark, paths, require_target=require_target)
    if multi_line is None:
        spanning = files_with_open_quotes(spark, paths)
    else:
        spanning = {layout.uri for layout in layouts} if multi_line else set()
    groups: dict[tuple[tuple[str, ...], bool], list[CsvLayout]] = {}
    for layout in layouts:
        groups.setdefault((layout.header, layout.uri in spanning), []).append(layout)
    allowed = sorted(S.ALLOWED)
    scans = []
    for (header, spans), members in groups.items():
        rows = _scan(spark, members, spans)
        columns: list[Column] = [F.nullif(F.col(c), F.lit("")).alias(c)
                                 for c in keep if c in header]
        columns += [parse.file_nulls(c).alias(c) for c in allowed if c in header]
        columns.append(_over_long(len(header)).alias(EXTRA))
        if with_source:
            columns.append(F.col(URI).alias("source_file"))
        scans.append(rows.select(*columns))
    combined = scans[0]
    for other in scans[1:]:
        combined = combined.unionByName(other, allowMissingColumns=True)
    return combined


def _over_long(width: int) -> Column:
    """Whether a row has more cells than the header, empty ones included. The reader keeps
    the text of every row of another width; only commas outside quotes part cells."""
    bare = F.regexp_replace(F.col(EXTRA), r'"(?:[^"]|"")*+"', "")
    return F.coalesce(F.regexp_count(bare, F.lit(",")) >= width, F.lit(False))


def require_sound(scan: DataFrame) -> DataFrame:
    """Refuse empty scans and rows with more fields than the header has."""
    row = scan.agg(F.count(F.lit(1)).alias("rows"), F.count_if(EXTRA).alias("long")).first()
    if not row["rows"]:
        raise DataContractError("ingestion produced zero rows")
    if row["long"]:
        raise DataContractError(f"{row['long']} rows have more fields than the header")
    return scan.drop(EXTRA)


def source_inventory(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Per file: bytes, digest, rows read, header rows skipped, ignored columns."""
    layouts = find_layouts(spark, paths)
    rows = scan_loans(spark, paths, with_source=True, **options).groupBy(
        F.col("source_file").alias("uri")).agg(F.count(F.lit(1)).alias("rows_read"))
    files = digests(spark.read.format("binaryFile").load([as_path(x.uri) for x in layouts]))
    facts = spark.createDataFrame(
        [(x.uri, shown(x.uri), x.header_line, len(set(x.header) & set(S.ALLOWED)),
          ",".join(x.ignored)) for x in layouts],
        "uri string, file string, header_rows_skipped int, columns_loaded int, "
        "ignored_columns string",
    )
    # From the facts outwards: a file that another read misses shows up with nulls.
    found = facts.join(files.drop("path"), "uri", "left").join(rows, "uri", "left")
    return found.select("file", "bytes", "sha256", F.coalesce("rows_read", F.lit(0)).alias(
        "rows_read"), "header_rows_skipped", "columns_loaded", "ignored_columns")


def read_cohort(
    spark: SparkSession, path: str, *, schema: str | T.StructType | None = None
) -> DataFrame:
    """A cohort from header CSV or a JSON array of objects. Unnamed header cells and
    rows of another width are errors."""
    if path.lower().rstrip("/").endswith(".json"):
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    frame = spark.read.option("header", True).option("mode", "FAILFAST").option(
        "enforceSchema", False
    )
    cohort = (frame.schema(schema) if schema else frame).csv(path)
    if any(not c.strip() or c.startswith("_c") for c in cohort.columns):
        raise DataContractError("each CSV column needs a header")
    return cohort


def allowed_loans(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    return outcomes.select_allowed(require_sound(scan_loans(spark, paths, **options)))
