"""File inventories, acquisition audits, structure checks and table export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.errors import DataContractError
from ledgerlens.sources import digests

# Columns an acquisition manifest must have.
MANIFEST_COLUMNS = (
    "source_id", "role", "canonical_url", "source_reported_version",
    "acquisition_completed_utc", "archive_filename", "archive_size_bytes", "archive_sha256",
    "pipeline_input_filename", "pipeline_input_size_bytes", "pipeline_input_sha256",
    "declared_license", "status",
)
# Export order, parents before children.
EXPORT_ORDER = (
    "roles", "permissions", "role_permissions", "users", "applications", "predictions",
    "feedback", "explanation_experiment_assignments", "explanation_experiment_exposures",
    "monitoring_snapshots", "retraining_tickets", "audit_events",
)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) below ``root``. Large files are hashed in segments, one task
    each (:mod:`digests`)."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(root)
    )
    prefix = root.rstrip("/").split(":")[-1] + "/"
    return digests.digests(raw).select(
        F.substring_index(F.col("path"), prefix, -1).alias("name"), "bytes", "sha256",
    )


def inventory_digest(listed: DataFrame) -> DataFrame:
    """File count and one digest over sorted names and contents: one short line per
    file reaches the final aggregate."""
    lines = F.sort_array(F.collect_list(F.concat_ws("\0", "name", "sha256")))
    return listed.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("bytes").alias("total_bytes"),
        F.sha2(F.concat_ws("\0", lines), 256).alias("digest"),
    )


def acquisition_audit(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per problem (source_id, problem); empty when the audit passes.

    Checks every acquired row's archive and pipeline input against the inventory,
    path escapes, missing timestamps and duplicate ids over all rows.
    """
    absent = [c for c in MANIFEST_COLUMNS if c not in manifest.columns]
    if absent:
        raise DataContractError(f"manifest is missing columns: {absent}")
    duplicates = (
        manifest.groupBy("source_id").count().filter("count > 1")
        .select("source_id", F.lit("duplicate source_id").alias("problem"))
    )
    acquired = manifest.filter(F.col("status").startswith("acquired_verified"))
    undated = acquired.filter(
        F.coalesce(F.trim("acquisition_completed_utc"), F.lit("")) == ""
    ).select("source_id", F.lit("missing acquisition timestamp").alias("problem"))
    claims = acquired.select("source_id", F.explode(F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.col(f"{kind}_filename").alias("name"),
            F.col(f"{kind}_size_bytes").cast("string").try_cast("bigint").alias("claimed_bytes"),
            F.lower(f"{kind}_sha256").alias("claimed_sha256"),
        )
        for kind in ("archive", "pipeline_input")
    ])).alias("claim")).select("source_id", "claim.*")
    escapes = F.col("name").startswith("/") | F.col("name").rlike(r"(^|/)\.\.(/|$)")
    problem = (
        F.when(escapes, "path escapes the root")
        .when(F.col("sha256").isNull(), "file is missing")
        .when(~F.col("bytes").eqNullSafe(F.col("claimed_bytes")), "size mismatch")
        .when(~F.col("sha256").eqNullSafe(F.col("claimed_sha256")), "digest mismatch")
    )
    mismatches = (
        claims.join(listed, "name", "left")
        .select("source_id", F.concat_ws(": ", "kind", problem).alias("problem"),
                problem.alias("_found"))
        .filter(F.col("_found").isNotNull()).drop("_found")
    )
    return duplicates.unionByName(undated).unionByName(mismatches)


def text_structure(lines: DataFrame, column: str = "value") -> DataFrame:
    """Shape of whitespace-separated text: rows, width range, ``?`` fields, and
    distinct last fields with their counts."""
    fields = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    rows = lines.filter(F.trim(column) != "").select(fields.alias("f"))
    return rows.select(
        F.size("f").alias("width"),
        F.size(F.filter("f", lambda x: x == "?")).alias("unknown"),
        F.element_at("f", -1).alias("label"),
    ).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
        F.sum("unknown").alias("missing_fields"),
    )


def require_structure(
    lines: DataFrame, *, rows: int = 1000, width: int = 21,
    labels: Mapping[str, int] = {"1": 700, "2": 300},
) -> None:
    """Fixed expectations of the secondary data set."""
    found = text_structure(lines).limit(len(labels) + 1).collect()
    shape = {r["label"]: r["rows"] for r in found}
    widths = {r["min_width"] for r in found} | {r["max_width"] for r in found}
    missing = sum(r["missing_fields"] for r in found)
    if shape != dict(labels) or sum(shape.values()) != rows or widths != {width} or missing:
        raise DataContractError(
            f"unexpected structure: labels {shape}, widths {widths}, missing {missing}"
        )


def export_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Each table as JSON lines with ISO timestamps, parents before children."""
    unknown = sorted(set(tables) - set(EXPORT_ORDER))
    if unknown:
        raise DataContractError(f"unknown tables: {unknown}")
    for name in EXPORT_ORDER:
        if name in tables:
            tables[name].write.mode(mode).option(
                "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
            ).json(f"{root}/{name}")


def write_report(report: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small aggregate as one headed CSV file."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
