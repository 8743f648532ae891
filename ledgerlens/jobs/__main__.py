"""Command line: ``python -m ledgerlens.jobs <command>`` or via spark-submit.

Commands: build, simulate-drift, train-model, validate, compare, drift-check, score.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlens import __version__
from ledgerlens.jobs import build, simulate, train
from ledgerlens.operators import drift, models, store
from ledgerlens.operators.perturb import Shift
from ledgerlens.operators.windows import TimeWindow
from ledgerlens.session import SESSION_DEFAULTS
from ledgerlens.sources import loans
from ledgerlens.streaming import score_stream

SHIFTED = {"int_rate": "int-rate", "dti": "dti"}


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="ledgerlens", description=__doc__)
    root.add_argument("--version", action="version", version=__version__)
    commands = root.add_subparsers(dest="command", required=True)

    b = commands.add_parser("build", help="build a feature store from loan CSVs")
    b.add_argument("--config", help="JSON file whose keys the flags override")
    b.add_argument("--input", action="append")
    b.add_argument("--feature-store")
    b.add_argument("--train-fraction", type=float)
    b.add_argument("--validation-fraction", type=float)
    b.add_argument("--shift-fraction", type=float)
    b.add_argument("--seed", type=int)
    b.add_argument("--single-line", action="store_true", help="no quoted newlines: skip the check for them")
    b.add_argument("--overwrite", action="store_true")

    s = commands.add_parser("simulate-drift", help="slice by time and shift columns")
    s.add_argument("feature_store")
    s.add_argument("--output", required=True)
    s.add_argument("--start")
    s.add_argument("--end")
    s.add_argument("--exclude-start", action="store_true")
    s.add_argument("--include-end", action="store_true")
    s.add_argument("--seed", type=int, default=simulate.DEFAULT_SEED)
    s.add_argument("--feature-view", choices=("unscaled", "scaled"), default="unscaled")
    for feature, flag in SHIFTED.items():
        s.add_argument(f"--{flag}-shift", type=float, dest=f"{feature}_shift")
        s.add_argument(f"--{flag}-mode", choices=("absolute", "relative"), default="absolute",
                       dest=f"{feature}_mode")
        s.add_argument(f"--{flag}-fraction", type=float, default=1.0, dest=f"{feature}_fraction")
        s.add_argument(f"--{flag}-min", type=float, dest=f"{feature}_min")
        s.add_argument(f"--{flag}-max", type=float, dest=f"{feature}_max")

    t = commands.add_parser("train-model", help="train, evaluate and save models")
    t.add_argument("feature_store")
    t.add_argument("--output-dir", required=True)
    t.add_argument("--seed", type=int, default=models.SEED)
    t.add_argument("--cv-splits", type=int, default=models.CV_FOLDS)
    t.add_argument("--overwrite", action="store_true")

    v = commands.add_parser("validate", help="check a feature store")
    v.add_argument("feature_store")

    c = commands.add_parser("compare", help="compare two feature stores")
    c.add_argument("left")
    c.add_argument("right")

    d = commands.add_parser("drift-check", help="KS test between two cohort files")
    d.add_argument("reference")
    d.add_argument("current")
    d.add_argument("--alpha", type=float, default=0.01)
    d.add_argument("--output")

    k = commands.add_parser("score", help="score raw loan CSVs with a saved bundle")
    k.add_argument("bundle")
    k.add_argument("--input", action="append", required=True)
    k.add_argument("--output", required=True)

    m = commands.add_parser("monitor", help="watch scores with the detector training primed")
    m.add_argument("models", help="output folder of train-model")
    m.add_argument("--scores", required=True, help="Parquet predictions")
    m.add_argument("--snapshots", required=True)
    m.add_argument("--checkpoint", required=True)
    m.add_argument("--feature-checks", help="output of drift-check")
    return root


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    return _COMMANDS[args.command](spark, args)


def _build(spark: SparkSession, args: argparse.Namespace) -> dict:
    config: dict = {}
    if args.config:
        text = spark.read.option("wholetext", True).text(args.config).first()["value"]
        config = json.loads(text)
    fractions = config.get("time_split", {})

    def pick(flag, configured):
        return configured if flag is None else flag

    inputs = args.input or [config["input_csv"]]
    manifest = build.build(
        spark, inputs, pick(args.feature_store, config.get("feature_store")),
        train_fraction=pick(args.train_fraction, fractions.get("train_fraction", 0.6)),
        validation_fraction=pick(
            args.validation_fraction, fractions.get("validation_fraction", 0.2)),
        shift_fraction=pick(args.shift_fraction, fractions.get("shift_fraction")),
        seed=pick(args.seed, config.get("random_seed", 20260926)),
        overwrite=args.overwrite, multi_line=False if args.single_line else None,
    )
    return {k: manifest[k] for k in ("row_counts", "total_rows", "partitions")}


def _simulate(spark: SparkSession, args: argparse.Namespace) -> dict:
    shifts = []
    for feature in SHIFTED:
        amount = getattr(args, f"{feature}_shift")
        if amount is not None:
            shifts.append(Shift(
                feature, amount, getattr(args, f"{feature}_mode"),
                getattr(args, f"{feature}_fraction"), getattr(args, f"{feature}_min"),
                getattr(args, f"{feature}_max")))
    window = TimeWindow(args.start, args.end, not args.exclude_start, args.include_end)
    result = simulate.simulate(
        spark, args.feature_store, window=window, shifts=shifts, seed=args.seed,
        view=args.feature_view)
    result.write(args.output)
    return result.summary


def _train(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = models.TrainingConfig(seed=args.seed, cv_folds=args.cv_splits)
    found = train.train(
        spark, args.feature_store, args.output_dir, config=config, overwrite=args.overwrite)
    return {n: {"threshold": e.threshold, "shift": e.shift} for n, e in found.items()}


def _validate(spark: SparkSession, args: argparse.Namespace) -> dict:
    return {"status": "passed", **store.validate_store(spark, args.feature_store)}


def _compare(spark: SparkSession, args: argparse.Namespace) -> dict:
    return store.compare_stores(spark, args.left, args.right)


def _drift_check(spark: SparkSession, args: argparse.Namespace) -> dict:
    results = drift.ks_drift(
        loans.read_cohort(spark, args.reference), loans.read_cohort(spark, args.current),
        alpha=args.alpha)
    snapshot = drift.feature_snapshot(results)
    if args.output:
        snapshot.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(
            args.output)
    return snapshot.first().asDict(recursive=True)


def _score(spark: SparkSession, args: argparse.Namespace) -> dict:
    bundle = models.load_bundle(spark, args.bundle)
    raw = loans.require_sound(loans.scan_loans(
        spark, args.input, require_target=False, keep=("loan_id",)))
    models.score_raw(build.with_loan_id(raw), bundle).write.parquet(args.output)
    return {"output": args.output, "model_version": bundle.version}


def _monitor(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Snapshots of all scores that have come since the last run; the first run starts from
    the states that training stored."""
    kinds = spark.read.parquet(args.scores).schema
    query = score_stream.run_monitor(
        spark.readStream.schema(kinds).parquet(args.scores), args.snapshots, args.checkpoint,
        primed=spark.read.parquet(f"{args.models}/detector"), feature_checks=args.feature_checks)
    query.awaitTermination()
    return {"snapshots": args.snapshots}


_COMMANDS = {
    "build": _build, "simulate-drift": _simulate, "train-model": _train, "validate": _validate,
    "compare": _compare, "drift-check": _drift_check, "score": _score,
    "monitor": _monitor,
}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"ledgerlens {args.command}")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    print(json.dumps(run(spark, args), default=str, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
