"""The quarter-partitioned feature store: write, read, prove, compare."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import derive
from ledgerlens.operators import dictionary, evidence, splits
from ledgerlens.operators.features import Preprocessor
from ledgerlens.operators.windows import TimeWindow, require_times, select_window

# Everything a store consists of; the manifest comes last and marks a complete store.
PARTS = ("unscaled", "scaled", "files", "artifacts", "data_dictionary", "status_inventory")
METADATA = (S.LOAN_ID, S.ISSUE_DATE, S.QUARTER, S.SPLIT, S.TARGET)
# Manifest fields that must agree between two builds.
STABLE_FIELDS = (
    "schema_version", "layout_version", "format", "compression", "partition_column",
    "date_column", "target_column", "split_column", "variants", "feature_names",
    "feature_dtypes", "row_counts", "total_rows", "partitions", "minimum_issue_quarter",
    "maximum_issue_quarter", "quarter_to_split", "data_dictionary", "pipeline_metadata",
)


def feature_columns(view: DataFrame) -> list[str]:
    return [c for c in view.columns if c not in METADATA]


def contract_counts(view: DataFrame) -> DataFrame:
    """One row of rule violations; all zeros (and rows > 0) for a sound view."""
    features = feature_columns(view)
    numeric = [
        c for c in features
        if isinstance(view.schema[c].dataType, (T.DoubleType, T.FloatType))
    ]
    # Spark makes one method of a chain of conditions, and the JVM does not compile one that
    # long; ``greatest`` is cut into short ones. NaN is greater than infinity.
    bad_value = F.greatest(F.lit(False), F.lit(False), *[F.col(c).isNull() for c in features])
    if numeric:
        largest = F.greatest(F.lit(0.0), F.lit(0.0), *[F.abs(F.col(c)) for c in numeric])
        bad_value = bad_value | (largest >= float("inf"))
    return view.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(S.TARGET).isNull() | ~F.col(S.TARGET).isin(0, 1)).alias("bad_target"),
        F.count_if(F.col(S.ISSUE_DATE).isNull()).alias("bad_date"),
        F.count_if(bad_value).alias("bad_feature"),
        F.count_if(
            ~derive.quarter_label(S.ISSUE_DATE).eqNullSafe(F.col(S.QUARTER))
        ).alias("bad_quarter"),
        *[F.count_if(F.col(S.SPLIT) == s).alias(f"{s}_rows") for s in S.SPLITS],
        F.count_if(F.col(S.SPLIT).isNull() | ~F.col(S.SPLIT).isin(*S.SPLITS)).alias("bad_split"),
    )


def quarter_profile(view: DataFrame) -> DataFrame:
    """Rows, positives and split bounds per quarter: the one aggregate behind the
    manifest, the validation and the one-split-per-quarter rule."""
    return view.groupBy(S.QUARTER).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(S.TARGET).cast("long")).alias("positives"),
        F.min(S.SPLIT).alias(S.SPLIT),
        F.max(S.SPLIT).alias("last_split"),
        F.min(S.ISSUE_DATE).alias("first_date"),
        F.max(S.ISSUE_DATE).alias("last_date"),
    )


def require_contract(view: DataFrame) -> None:
    row = contract_counts(view).first().asDict()
    broken = {k: v for k, v in row.items() if k.startswith("bad_") and v}
    empty = [s for s in S.SPLITS if not row[f"{s}_rows"]]
    if not row["rows"] or broken or empty:
        raise DataContractError(f"view breaks its contract: {broken}, empty splits: {empty}")


def manifest_counts(view: DataFrame) -> DataFrame:
    """Counts part of the manifest in long form (section, key, value)."""
    profile = quarter_profile(view)
    parts = {
        "quarter_rows": (F.col(S.QUARTER), F.col("rows")),
        "split_rows": (F.col(S.SPLIT), F.col("rows")),
        "split_quarters": (F.col(S.SPLIT), F.lit(1).cast("long")),
        "total_rows": (F.lit("all"), F.col("rows")),
    }
    entries = F.array(*[
        F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
        for section, (key, value) in parts.items()
    ])
    return (
        profile.select(F.explode(entries).alias("e")).select("e.*")
        .groupBy("section", "key").agg(F.sum("value").alias("value"))
    )


def build_manifest(
    view: DataFrame,
    preprocessor: Preprocessor,
    *,
    data_dictionary: Sequence[Sequence] = (),
    extra: dict | None = None,
) -> dict:
    """Bounded metadata only: one profile row per quarter reaches the driver."""
    profile = quarter_profile(view).orderBy(S.QUARTER).collect()
    if not profile:
        raise DataContractError("cannot describe an empty view")
    crossing = [r[S.QUARTER] for r in profile if r[S.SPLIT] != r["last_split"]]
    if crossing:
        raise DataContractError(f"quarters that cross splits: {crossing}")
    quarters = [r[S.QUARTER] for r in profile]
    row_counts = {s: sum(r["rows"] for r in profile if r[S.SPLIT] == s) for s in S.SPLITS}
    return {
        "schema_version": S.SCHEMA_VERSION,
        "layout_version": S.LAYOUT_VERSION,
        "format": "parquet",
        "compression": "snappy",
        "partition_column": S.QUARTER,
        "date_column": S.ISSUE_DATE,
        "target_column": S.TARGET,
        "split_column": S.SPLIT,
        "variants": list(S.VIEWS),
        "feature_names": preprocessor.feature_names,
        "feature_schema_sha256": preprocessor.schema_digest,
        "feature_dtypes": {
            c: view.schema[c].dataType.simpleString() for c in preprocessor.feature_names
        },
        "row_counts": row_counts,
        "positive_counts": {
            s: sum(r["positives"] for r in profile if r[S.SPLIT] == s) for s in S.SPLITS
        },
        "total_rows": sum(row_counts.values()),
        "partitions": quarters,
        "minimum_issue_quarter": quarters[0],
        "maximum_issue_quarter": quarters[-1],
        "quarter_to_split": {r[S.QUARTER]: r[S.SPLIT] for r in profile},
        "data_dictionary": [list(row) for row in data_dictionary],
        "pipeline_metadata": extra or {},
    }


def write_view(view: DataFrame, path: str, mode: str, *, placed: bool = False) -> None:
    """One folder per quarter. The rebalance hint lets adaptive execution split a
    hot quarter over many files and merge tiny ones; sorting by date inside each
    file keeps min/max statistics useful for window reads. Rows read from a view's
    files are ``placed`` by quarter already, so they need no second shuffle."""
    (
        (view if placed else view.hint("rebalance", S.QUARTER))
        .sortWithinPartitions(S.QUARTER, S.ISSUE_DATE, S.LOAN_ID)
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy(S.QUARTER)
        .parquet(path)
    )


def write_store(
    typed: DataFrame,
    preprocessor: Preprocessor,
    root: str,
    *,
    overwrite: bool = False,
    raw: DataFrame | None = None,
    extra: dict | None = None,
    statuses: DataFrame | None = None,
) -> dict:
    """Write both views, the facts of their files, the preprocessor and the dictionary, and
    last the manifest, whose presence marks a complete store. ``typed`` carries split and target.

    Everything is written to a folder inside ``root`` that readers pass over, and proven there.
    Only then do its parts move to their places: a store that is overwritten stays whole until
    the new one is known to be sound. Moves are renames of folders; where a file system copies
    instead, a broken move leaves no manifest, so no reader takes the store for complete.
    The scaled view is derived from the unscaled files, so raw parsing runs once.
    """
    spark = typed.sparkSession
    root = root.rstrip("/")
    taken = [p for p in (*PARTS, "manifest") if _exists(spark, f"{root}/{p}")]
    if taken and not overwrite:
        raise DataContractError(f"store {root} already exists: {taken}")
    stage = f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        manifest = _write_parts(typed, preprocessor, stage, raw, extra, statuses)
        if taken:  # from here to the new manifest the store is not complete
            _remove(spark, f"{root}/manifest")
        for part in PARTS:
            _remove(spark, f"{root}/{part}")
            if _exists(spark, f"{stage}/{part}"):
                _move(spark, f"{stage}/{part}", f"{root}/{part}")
        _move(spark, f"{stage}/manifest", f"{root}/manifest")
    finally:
        _remove(spark, stage)
    return manifest


def _write_parts(
    typed: DataFrame, preprocessor: Preprocessor, root: str, raw: DataFrame | None,
    extra: dict | None, statuses: DataFrame | None,
) -> dict:
    spark = typed.sparkSession
    write_view(preprocessor.transform(typed), f"{root}/unscaled", "errorifexists")
    unscaled = _view(spark, root, "unscaled")
    require_contract(unscaled)
    write_view(preprocessor.scale(unscaled), f"{root}/scaled", "errorifexists", placed=True)
    for view in S.VIEWS:
        evidence.file_facts(spark, f"{root}/{view}").write.parquet(f"{root}/files/{view}")
    preprocessor.save(spark, f"{root}/artifacts/preprocessor", "errorifexists")
    rows: list = []
    if raw is not None:
        described = dictionary.data_dictionary(raw, typed, preprocessor)
        rows = sorted(tuple(r) for r in described.collect())
        spark.createDataFrame(rows, described.schema).coalesce(1).write.option(
            "header", True
        ).csv(f"{root}/data_dictionary")
    if statuses is not None:
        statuses.coalesce(1).write.parquet(f"{root}/status_inventory")
    manifest = build_manifest(unscaled, preprocessor, data_dictionary=rows, extra=extra)
    manifest["artifact_sha256"] = {"preprocessor": preprocessor_digest(preprocessor)}
    manifest["quarter_digests"] = {
        view: evidence.as_mapping(evidence.quarter_digests(
            spark.read.parquet(f"{root}/files/{view}")))
        for view in S.VIEWS
    }
    frame = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    frame.coalesce(1).write.text(f"{root}/manifest")
    return manifest


def content_fields(manifest: Mapping) -> dict:
    """The manifest without digests of fitted values and what they scale: their last digits
    may differ between two builds of the same rows."""
    kept = {k: v for k, v in manifest.items() if k not in ("artifact_sha256", "quarter_digests")}
    return {**kept, "quarter_digests": manifest.get("quarter_digests", {}).get("unscaled", {})}


def preprocessor_digest(preprocessor: Preprocessor) -> str:
    return hashlib.sha256(preprocessor.to_json().encode()).hexdigest()


def read_manifest(spark: SparkSession, root: str) -> dict:
    if not _exists(spark, f"{root}/manifest"):
        raise DataContractError(f"store {root} is incomplete: it has no manifest")
    row = spark.read.text(f"{root}/manifest").first()
    if row is None:
        raise DataContractError(f"store {root} is incomplete: its manifest is empty")
    return json.loads(row["value"])


def read_store(
    spark: SparkSession,
    root: str,
    view: str = "unscaled",
    columns: Sequence[str] | None = None,
    *,
    ordered: bool = False,
) -> DataFrame:
    """A lazy view scan of a complete store; column and partition pruning are Catalyst's.
    The total order by (issue_d, dataset_split, loan_id) costs a range shuffle, so it is
    only done on request."""
    if view not in S.VIEWS:
        raise DataContractError(f"view must be one of {S.VIEWS}")
    if not _exists(spark, f"{root}/manifest"):
        raise DataContractError(f"store {root} is incomplete: it has no manifest")
    frame = _view(spark, root, view, columns)
    if ordered:
        keys = [c for c in (S.ISSUE_DATE, S.SPLIT, S.LOAN_ID) if c in frame.columns]
        frame = frame.orderBy(*keys)
    return frame


def _view(
    spark: SparkSession, root: str, view: str, columns: Sequence[str] | None = None,
) -> DataFrame:
    frame = spark.read.parquet(f"{root}/{view}")
    # Partition folders are read back as text even where type inference is on.
    frame = frame.withColumn(S.QUARTER, F.col(S.QUARTER).cast("string"))
    if columns is not None:
        frame = frame.select(*columns)
    else:
        lead = [c for c in METADATA if c in frame.columns]
        frame = frame.select(*lead, *feature_columns(frame))
    return frame


@dataclass(frozen=True)
class WindowRead:
    frame: DataFrame
    view: str | None
    source: str


def read_window(
    spark: SparkSession,
    path: str,
    window: TimeWindow | None = None,
    *,
    time_column: str = S.ISSUE_DATE,
    view: str | None = "unscaled",
) -> WindowRead:
    """Read a window from a Parquet file, a dataset folder or a complete store (whose
    ``unscaled`` view is the default). Missing times are an error.

    A store knows the times of its files: missing ones are counted there, and files of the
    window's first and last quarter that hold none of its rows are not opened. If the files
    are not those the store was written with, the rows are read as in any other folder.
    """
    window = window or TimeWindow()
    source, chosen = path, None
    if view is not None and _exists(spark, f"{path}/{view}"):
        source, chosen = f"{path}/{view}", view
        if not _exists(spark, f"{path}/manifest"):
            raise DataContractError(f"store {path} is incomplete: it has no manifest")
    frame = spark.read.parquet(source)
    facts = None
    if chosen and time_column == S.ISSUE_DATE:
        facts = _known_files(spark, path, chosen, frame)
    if facts is None:
        require_times(frame, time_column)
        return WindowRead(select_window(frame, window, time_column), chosen, source)
    missing = facts.agg(F.sum("missing_times").alias("n")).first()["n"]
    if missing:
        raise DataContractError(f"time column {time_column!r} has {missing} missing values")
    skipped = [r["file"] for r in evidence.outside(facts, window).collect()]
    if skipped:
        frame = frame.filter(~evidence.file_name().isin(skipped))
    return WindowRead(select_window(frame, window, time_column), chosen, source)


def _known_files(
    spark: SparkSession, root: str, view: str, frame: DataFrame,
) -> DataFrame | None:
    """The facts of a view's files, or nothing where they are not about the files it has.
    Names are compared on the driver, where Spark's own listing of the folder is."""
    if not _exists(spark, f"{root}/files/{view}"):
        return None
    facts = spark.read.parquet(f"{root}/files/{view}")
    listed = {"/".join(name.rsplit("/", 2)[-2:]) for name in frame.inputFiles()}
    return facts if listed == {r["file"] for r in facts.select("file").collect()} else None


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path; works on any file system it can read."""
    place, system = _place(spark, path)
    return system.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    if system.exists(place) and not system.delete(place, True):
        raise DataContractError(f"cannot replace {path}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    place, system = _place(spark, source)
    if not system.rename(place, _place(spark, target)[0]):
        raise DataContractError(f"cannot move {source} to {target}")


def views_agree(unscaled: DataFrame, scaled: DataFrame) -> DataFrame:
    """One row of mismatch counts between the views' metadata, joined on the loan."""
    fields = [c for c in METADATA if c != S.LOAN_ID]
    left = unscaled.select(S.LOAN_ID, F.struct(*fields).alias("u"))
    right = scaled.select(S.LOAN_ID, F.struct(*fields).alias("s"))
    both = left.join(right, S.LOAN_ID, "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("u").isNull() | F.col("s").isNull()).alias("unmatched"),
        *[
            F.count_if(~F.col(f"u.{c}").eqNullSafe(F.col(f"s.{c}"))).alias(f"{c}_mismatches")
            for c in fields
        ],
    )


def content_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (as a multiset) only in ``left`` and only in ``right``, by side.

    Counting signed copies per distinct row finds both differences with one
    shuffle, and copies of one row shrink before it.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(
        right.select(*columns).withColumn("_sign", F.lit(-1))
    )
    return (
        signed.groupBy(*columns).agg(F.sum("_sign").alias("_copies"))
        .filter("_copies <> 0")
        .withColumn("side", F.when(F.col("_copies") > 0, "left_only").otherwise("right_only"))
        .withColumn("copies", F.abs("_copies"))
        .drop("_copies")
    )


def rows_apart(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Count of loans whose metadata differ or whose features are further apart than
    ``tolerance``; scaled values inherit the last-digit noise of the scaler."""
    features, fields = feature_columns(left), [c for c in METADATA if c != S.LOAN_ID]

    def packed(view: DataFrame, name: str) -> DataFrame:
        values = F.array(*[F.col(c).cast("double") for c in features])
        return view.select(S.LOAN_ID, F.struct(*fields, values.alias("v")).alias(name))

    both = packed(left, "a").join(packed(right, "b"), S.LOAN_ID, "full_outer")
    differs = F.exists(
        F.zip_with("a.v", "b.v", lambda x, y: F.abs(x - y) > tolerance), lambda d: d
    )
    for c in fields:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.agg(F.count_if(F.coalesce(differs, F.lit(True))).alias("rows_apart"))


def compare_stores(spark: SparkSession, left: str, right: str) -> dict:
    """Raise when two stores differ in stable manifest fields, fitted state or rows."""
    a, b = read_manifest(spark, left), read_manifest(spark, right)
    differing = [f for f in STABLE_FIELDS if a.get(f) != b.get(f)]
    if differing:
        raise DataContractError(f"stable manifest fields differ: {differing}")
    fitted = [Preprocessor.load(spark, f"{root}/artifacts/preprocessor") for root in (left, right)]
    if not fitted[0].matches(fitted[1]):
        raise DataContractError("fitted preprocessing state differs")
    sides = [
        {v: proven_digests(spark, root, manifest, v) for v in S.VIEWS}
        for root, manifest in ((left, a), (right, b))
    ]
    quarters = {v: evidence.differing(sides[0][v], sides[1][v]) for v in S.VIEWS}

    def apart(view: str) -> list[DataFrame]:
        return [read_store(spark, root, view).filter(F.col(S.QUARTER).isin(quarters[view]))
                for root in (left, right)]

    if quarters["unscaled"]:
        changed = content_difference(*apart("unscaled"))
        rows = changed.groupBy("side").agg(F.sum("copies").alias("rows")).collect()
        if rows:
            raise DataContractError(
                f"unscaled rows differ: { {r['side']: r['rows'] for r in rows} }, "
                f"quarters {quarters['unscaled']}")
    if quarters["scaled"]:
        found = rows_apart(*apart("scaled")).first()["rows_apart"]
        if found:
            raise DataContractError(
                f"scaled rows differ: {found}, quarters {quarters['scaled']}")
    return {"status": "passed", "stable_manifest_fields_verified": len(STABLE_FIELDS),
            "quarters_compared_by_row": {v: len(q) for v, q in quarters.items()}}


def proven_digests(
    spark: SparkSession, root: str, manifest: Mapping, view: str,
) -> dict[str, str]:
    """The digests of a view's rows as they are now, which must be those of its manifest."""
    found = evidence.as_mapping(
        evidence.quarter_digests(evidence.file_facts(spark, f"{root}/{view}")))
    stated = manifest.get("quarter_digests", {}).get(view, found)
    changed = evidence.differing(found, stated)
    if changed:
        raise DataContractError(
            f"{view} rows of {root} differ from its manifest in quarters {changed}")
    return found


def validate_store(spark: SparkSession, root: str) -> dict:
    """All proofs of a written store, the cheap ones first, or an error that names the first
    that fails: no leaking feature, quarters in order, fitted state and dictionary as stated,
    quarters and rows of both views those of the manifest by their digests, the proofs of
    ``load_views``, one split per quarter, and counts. Returns the facts of the scaled view."""
    manifest = read_manifest(spark, root)
    leaking = sorted(set(manifest["feature_names"]) & set(S.POST_ORIGINATION))
    if leaking:
        raise DataContractError(f"features known only after origination: {leaking}")
    quarters = manifest["partitions"]
    if quarters != sorted(set(quarters)):
        raise DataContractError("manifest quarters are not in order")
    fitted = Preprocessor.load(spark, f"{root}/artifacts/preprocessor")
    stated = manifest.get("artifact_sha256", {}).get("preprocessor")
    if stated and preprocessor_digest(fitted) != stated:
        raise DataContractError("the stored preprocessor differs from the manifest")
    if fitted.feature_names != manifest["feature_names"]:
        raise DataContractError("the stored preprocessor makes other features than the manifest")
    if manifest["data_dictionary"]:
        described = {row[0] for row in manifest["data_dictionary"] if not row[5]}
        if described != set(manifest["feature_names"]):
            raise DataContractError("the data dictionary describes other features")
    for view in S.VIEWS:
        if sorted(proven_digests(spark, root, manifest, view)) != quarters:
            raise DataContractError(f"quarters of the {view} view differ from the manifest")
    unscaled, scaled, _ = load_views(spark, root)
    assigned = {r[S.QUARTER]: (r[S.SPLIT], r["last_split"])
                for r in quarter_profile(unscaled).collect()}
    wrong = [q for q in quarters if assigned[q] != (manifest["quarter_to_split"][q],) * 2]
    if wrong:
        raise DataContractError(f"splits differ from the manifest in quarters {wrong}")
    facts = store_validation(scaled).first().asDict()
    counts = {s: facts[f"{s}_rows"] for s in manifest["row_counts"]}
    if (counts, facts["total_rows"]) != (manifest["row_counts"], manifest["total_rows"]):
        raise DataContractError(f"row counts differ from the manifest: {counts}")
    return facts


def store_validation(scaled: DataFrame) -> DataFrame:
    """One row of facts: partitions, counts per split and class, largest absolute
    scaled training mean. Per-quarter sums first, so one shuffle of one row per
    quarter and task serves everything."""
    features = feature_columns(scaled)
    in_train = F.col(S.SPLIT) == "train"
    per_quarter = scaled.groupBy(S.QUARTER).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col(S.TARGET).cast("long")).alias("_positives"),
        F.min(S.SPLIT).alias("_first_split"),
        F.max(S.SPLIT).alias("_last_split"),
        *[F.sum(F.when(in_train, F.col(c)).otherwise(0.0)).alias(c) for c in features],
    )
    train_rows = F.sum(F.when(F.col("_first_split") == "train", F.col("_rows")).otherwise(0))
    return per_quarter.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.min(S.QUARTER).alias("minimum_issue_quarter"),
        F.max(S.QUARTER).alias("maximum_issue_quarter"),
        F.sum("_rows").alias("total_rows"),
        F.sum("_positives").alias("positives"),
        F.count_if(F.col("_first_split") != F.col("_last_split")).alias("quarters_crossing"),
        *[
            F.sum(F.when(F.col("_first_split") == s, F.col("_rows")).otherwise(0))
            .alias(f"{s}_rows")
            for s in S.SPLITS
        ],
        F.greatest(*[F.abs(F.sum(c) / train_rows) for c in features])
        .alias("max_abs_scaled_train_mean"),
    )


def load_views(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """Both views with the proofs that modeling relies on."""
    manifest = read_manifest(spark, root)
    names = manifest["feature_names"]
    if sorted(set(names) & set(METADATA)):
        raise DataContractError("metadata columns are listed as features")
    views = [read_store(spark, root, v) for v in S.VIEWS]
    for view in views:
        absent = [c for c in (*METADATA, *names) if c not in view.columns]
        if absent:
            raise DataContractError(f"view is missing columns: {absent}")
        require_contract(view)
    agreement = views_agree(*views).first().asDict()
    if any(v for k, v in agreement.items() if k != "rows"):
        raise DataContractError(f"views disagree: {agreement}")
    if not splits.split_order(views[0]).first()["chronological"]:
        raise DataContractError("temporal splits overlap")
    return views[0], views[1], manifest
