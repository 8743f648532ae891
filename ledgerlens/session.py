"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Wide parsing projections compile to one method that the JVM would refuse to
    # optimise; past its limit of 8000 bytes Spark then splits them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


# Settings a running session can still take.
RUNTIME_DEFAULTS = {
    key: SESSION_DEFAULTS[key]
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")
}


def apply_runtime_defaults(spark: SparkSession) -> None:
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)


def local_session(cores: int = 8, app: str = "ledgerlens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SESSION_DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in an unconfigured local
    session, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        current = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so that all of
    an application's intermediate tables can be dropped with one folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Cuts lineage, so losing an executor cannot change values that later steps read
    again, and being Parquet, later passes read only the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
