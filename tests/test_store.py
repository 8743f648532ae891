"""Feature store, windows and perturbation."""

import datetime as dt
import json
import math
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.jobs import simulate
from ledgerlens.operators import evidence, features, outcomes, perturb, splits, store
from ledgerlens.operators.windows import TimeWindow, select_window


@pytest.fixture
def written(spark, raw_loans, tmp_path):
    typed = features.type_columns(outcomes.resolve(raw_loans))
    frame = splits.plan_split(typed).apply(typed)
    fitted = features.fit(frame.filter(F.col(S.SPLIT) == "train"))
    root = str(tmp_path / "store")
    manifest = store.write_store(frame, fitted, root, raw=raw_loans)
    return root, manifest, frame, fitted


@pytest.fixture
def six(spark):
    """Six rows around the turn of 2018."""
    rows = [
        ("2017-12-31", "2017Q4", "train", "a", 5.0, 10.0, 50000.0, 0),
        ("2018-01-01", "2018Q1", "train", "b", 10.0, 20.0, 60000.0, 0),
        ("2018-01-02", "2018Q1", "validation", "c", 15.0, 30.0, 70000.0, 1),
        ("2018-01-03", "2018Q1", "validation", "d", 20.0, 40.0, 80000.0, 0),
        ("2018-01-04", "2018Q1", "test", "e", None, 50.0, 90000.0, 1),
        ("2018-04-01", "2018Q2", "test", "f", 30.0, 60.0, 100000.0, 1),
    ]
    return spark.createDataFrame(
        [(dt.datetime.fromisoformat(r[0]), *r[1:]) for r in rows],
        "issue_d timestamp, issue_quarter string, dataset_split string, loan_id string, "
        "int_rate double, dti double, annual_inc double, target int")


def test_manifest_and_layout(spark, written):
    root, manifest, frame, fitted = written
    assert manifest["row_counts"] == {"train": 4, "validation": 1, "shift": 3}
    assert len(manifest["partitions"]) == 8
    assert store.read_manifest(spark, root) == manifest
    unscaled = store.read_store(spark, root)
    assert store.feature_columns(unscaled) == fitted.feature_names
    assert unscaled.schema[S.QUARTER].dataType.simpleString() == "string"
    changed = store.content_difference(fitted.transform(frame), unscaled)
    assert changed.count() == 0
    assert store.views_agree(unscaled, store.read_store(spark, root, "scaled")).first()["rows"] == 8
    _, scaled, _ = store.load_views(spark, root)
    facts = store.store_validation(scaled).first()
    assert facts["total_rows"] == 8 and facts["max_abs_scaled_train_mean"] < 1e-9


def test_store_refuses_overwrite_and_compares(spark, written, tmp_path):
    root, _, frame, fitted = written
    with pytest.raises(Exception, match="(?i)already exists"):
        store.write_store(frame, fitted, root)
    again = str(tmp_path / "again")
    store.write_store(frame, fitted, again)
    with pytest.raises(DataContractError, match="data_dictionary"):
        store.compare_stores(spark, root, again)
    third = str(tmp_path / "third")
    store.write_store(frame, fitted, third, overwrite=True)
    assert store.compare_stores(spark, again, third)["status"] == "passed"
    scaled = store.read_store(spark, again, "scaled")
    assert store.rows_apart(scaled, scaled.withColumn("dti", F.col("dti") + 1e-12)).first()[0] == 0
    assert store.rows_apart(scaled, scaled.withColumn("dti", F.col("dti") + 1e-3)).first()[0] == 8
    assert store.rows_apart(scaled, scaled.filter("loan_id > 2")).first()[0] == 3
    store.write_store(frame.withColumn("dti", F.col("dti") + 1), fitted, third, overwrite=True)
    with pytest.raises(DataContractError, match="rows differ"):
        store.compare_stores(spark, again, third)


def test_overwrite_keeps_the_old_store_until_the_new_one_is_proven(spark, written):
    root, manifest, frame, fitted = written
    rows = store.read_store(spark, root).count()
    with pytest.raises(DataContractError, match="contract"):
        store.write_store(frame.filter("dataset_split <> 'shift'"), fitted, root, overwrite=True)
    assert store.read_manifest(spark, root) == manifest
    assert store.read_store(spark, root).count() == rows
    store.write_store(frame, fitted, root, overwrite=True)
    names = {p.name for p in Path(root).iterdir()}
    assert names == {"unscaled", "scaled", "files", "artifacts", "manifest"}


def test_readers_refuse_a_store_without_manifest(spark, written):
    root, *_ = written
    (Path(root) / "manifest").rename(Path(root) / "_manifest")
    for read in (store.read_store, store.read_window, store.read_manifest, store.validate_store):
        with pytest.raises(DataContractError, match="no manifest"):
            read(spark, root)


def test_validation_names_what_differs(spark, written, tmp_path):
    root, manifest, *_ = written
    assert store.validate_store(spark, root)["total_rows"] == 8

    def with_manifest(**fields):
        copy = tmp_path / f"copy{len(list(tmp_path.iterdir()))}"
        shutil.copytree(root, copy)
        text = json.dumps({**manifest, **fields})
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(
            f"{copy}/manifest")
        return str(copy)

    digests = manifest["quarter_digests"]
    for fields, message in (
        ({"partitions": manifest["partitions"][::-1]}, "in order"),
        ({"partitions": manifest["partitions"][1:]}, "quarters of"),
        ({"quarter_to_split": dict.fromkeys(manifest["partitions"], "train")}, "splits differ"),
        ({"row_counts": {**manifest["row_counts"], "train": 5}}, "row counts"),
        ({"artifact_sha256": {"preprocessor": "0"}}, "preprocessor differs"),
        ({"data_dictionary": manifest["data_dictionary"][1:]}, "dictionary"),
        ({"quarter_digests": {**digests, "scaled": {**digests["scaled"], "2016Q1": "1:0"}}},
         "scaled rows .*2016Q1"),
    ):
        with pytest.raises(DataContractError, match=message):
            store.validate_store(spark, with_manifest(**fields))


def test_digests_count_copies_and_nulls(spark):
    kinds = "q string, a int, b int"
    rows = [("x", 1, None), ("x", None, 1), ("x", 1, None), ("y", 2, 3)]
    table = spark.createDataFrame(rows, kinds)

    def of(frame):
        return {r["q"]: (r["rows"], r["digest"])
                for r in evidence.content_digests(frame, "q").collect()}

    assert of(table) == of(table.repartition(3).select("b", "q", "a"))
    changed = (
        [("x", 1, None), ("x", None, 1), ("x", None, 1), ("y", 2, 3)],
        [("x", 1, None), ("x", None, 1), ("y", 2, 3)],
        [("x", 1, None), ("x", 1, None), ("x", 1, None), ("y", 2, 3)],
    )
    for other in changed:
        found = of(spark.createDataFrame(other, kinds))
        assert found["x"] != of(table)["x"] and found["y"] == of(table)["y"]
    assert of(table.limit(0)) == {}
    assert evidence.content_digests(table.limit(0)).count() == 0
    assert evidence.content_digests(table).first()["rows"] == 4


def test_facts_of_files_add_up_to_the_rows(spark, written):
    root, manifest, *_ = written
    for view in S.VIEWS:
        stored = spark.read.parquet(f"{root}/files/{view}")
        whole = evidence.content_digests(store.read_store(spark, root, view), S.QUARTER)
        assert evidence.as_mapping(whole) == evidence.as_mapping(evidence.quarter_digests(stored))
        assert evidence.as_mapping(whole) == manifest["quarter_digests"][view]


def test_equal_stores_compare_without_shuffling_rows(spark, written, tmp_path, monkeypatch):
    root, _, frame, fitted = written
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.write_store(frame, fitted, a)
    store.write_store(frame.repartition(5), fitted, b)

    def refuse(*_):
        raise AssertionError("rows were compared")

    with monkeypatch.context() as m:
        m.setattr(store, "content_difference", refuse)
        m.setattr(store, "rows_apart", refuse)
        assert store.compare_stores(spark, a, b)["quarters_compared_by_row"] == {
            "unscaled": 0, "scaled": 0}
    plan = evidence.file_facts(spark, f"{a}/unscaled")._jdf.queryExecution().executedPlan()
    assert "partial_sum" in plan.toString()


def test_window_skips_files_and_counts_missing_times_from_facts(spark, written, tmp_path):
    root, *_ = written
    # A quarter of several files: one a month, with facts of its own.
    many = str(tmp_path / "many")
    days = [(dt.datetime(2016, m, d), "2016Q1", m * 100 + d) for m in (1, 2, 3) for d in (1, 20)]
    view = spark.createDataFrame(days, "issue_d timestamp, issue_quarter string, loan_id int")
    view.repartitionByRange(3, "issue_d").write.partitionBy(S.QUARTER).parquet(f"{many}/unscaled")
    facts = evidence.file_facts(spark, f"{many}/unscaled")
    facts.write.parquet(f"{many}/files/unscaled")
    spark.createDataFrame([("{}",)], "value string").write.text(f"{many}/manifest")
    for window, ids, opened in (
        (TimeWindow("2016-02-01", "2016-03-01"), [201, 220], 1),
        (TimeWindow("2016-01-20", "2016-02-01", include_end=True), [120, 201], 2),
        (TimeWindow("2016-01-20", "2016-03-01", include_start=False), [201, 220], 1),
        (TimeWindow("2017-01-01"), [], 0), (TimeWindow(), [101, 120, 201, 220, 301, 320], 3),
    ):
        frame = store.read_window(spark, many, window).frame
        assert sorted(r["loan_id"] for r in frame.collect()) == ids
        skipped = {r["file"] for r in evidence.outside(facts, window).collect()}
        inside = facts.filter(window.partition_predicate()).count()
        assert inside - len(skipped) == opened
    # A file of the same quarter without rows of the window is not opened.
    last = facts.orderBy(F.desc("first_time")).first()["file"]
    march = Path(many) / "unscaled" / last
    sound = march.read_bytes()
    (march.parent / f".{march.name}.crc").unlink()
    march.write_bytes(b"x" * len(sound))
    january = store.read_window(spark, many, TimeWindow("2016-01-01", "2016-02-01")).frame
    assert sorted(r["loan_id"] for r in january.collect()) == [101, 120]
    march.write_bytes(sound)
    # A file the facts do not know: rows are read, and its missing time is an error.
    extra = spark.createDataFrame([(None, "2016Q1", 9)], view.schema)
    extra.write.mode("append").partitionBy(S.QUARTER).parquet(f"{many}/unscaled")
    with pytest.raises(DataContractError, match="missing values"):
        store.read_window(spark, many, TimeWindow("2016-02-01", "2016-03-01"))


def test_content_difference_counts_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    right = spark.createDataFrame([(1,), (3,)], "a int")
    rows = {(r["a"], r["side"]): r["copies"] for r in store.content_difference(left, right).collect()}
    assert rows == {(1, "left_only"): 1, (2, "left_only"): 1, (3, "right_only"): 1}


def test_contract_is_enforced(written):
    _, _, frame, fitted = written
    view = fitted.transform(frame)
    store.require_contract(view)
    for broken in (view.withColumn("target", F.lit(2)),
                   view.withColumn("dti", F.lit(float("nan"))),
                   view.withColumn("issue_quarter", F.lit("1999Q1")),
                   view.filter("dataset_split <> 'shift'")):
        with pytest.raises(DataContractError):
            store.require_contract(broken)
    crossing = view.withColumn("issue_quarter", F.lit("2016Q1"))
    with pytest.raises(DataContractError, match="cross"):
        store.build_manifest(crossing, fitted)


def test_window_reads_prune_partitions(spark, written):
    root, *_ = written
    read = store.read_window(spark, root, TimeWindow("2016-07-01", "2017-01-01"))
    assert (read.view, read.frame.count()) == ("unscaled", 2)
    plan = read.frame.select("loan_id", "dti")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue_quarter" in plan
    assert "2016Q3" in plan and "PushedFilters: [IsNotNull(issue_d)" in plan
    assert "annual_inc" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("include_start, include_end, days", [
    (True, True, [2, 3, 4]), (True, False, [2, 3]), (False, True, [3, 4]), (False, False, [3])])
def test_window_bounds(six, include_start, include_end, days):
    window = TimeWindow("2018-01-02", "2018-01-04", include_start, include_end)
    rows = select_window(six, window).orderBy("issue_d").collect()
    assert [r["issue_d"].day for r in rows] == days


def test_window_is_utc_and_ordered(six):
    shifted = TimeWindow("2018-01-02T01:00:00+01:00", "2018-01-03T00:00:00")
    assert select_window(six, shifted).count() == 1
    assert select_window(six, TimeWindow()).count() == 6
    with pytest.raises(DataContractError):
        TimeWindow("2018-01-02", "2018-01-01")


def test_perturb_golden_values(six):
    shifts = [perturb.Shift("int_rate", 5.0, lower=0.0, upper=22.0),
              perturb.Shift("dti", 0.1, mode="relative", upper=55.0)]
    rows = perturb.apply_shifts(six, shifts, protected=("target",)).orderBy("issue_d").collect()
    assert [r["int_rate"] for r in rows] == [10, 15, 20, 22, None, 22]
    assert [r["dti"] for r in rows] == pytest.approx([11, 22, 33, 44, 55, 55])
    assert [r["annual_inc"] for r in rows] == [50000 + 10000 * i for i in range(6)]


def test_sampled_size_seed_and_partitions(spark, six):
    copies = six.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy")).withColumn(
        "loan_id", F.concat("loan_id", F.col("copy").cast("string")))
    shift = perturb.Shift("int_rate", 1.0, fraction=0.35)
    chosen, eligible, taken = perturb.selection(
        copies, shift, seed=4, operation=0, row_id="loan_id")
    assert (eligible, taken) == (50, 18)
    first = {r[0] for r in copies.filter(chosen).select("loan_id").collect()}
    again, *_ = perturb.selection(
        copies.repartition(7), shift, seed=4, operation=0, row_id="loan_id")
    other, *_ = perturb.selection(copies, shift, seed=4, operation=1, row_id="loan_id")
    assert len(first) == 18
    assert first == {r[0] for r in copies.filter(again).select("loan_id").collect()}
    assert first != {r[0] for r in copies.filter(other).select("loan_id").collect()}


@pytest.mark.parametrize("n, fraction, expected", [
    (0, 0.5, 0), (10, 0.0, 0), (10, 0.01, 1), (5, 0.5, 3), (10, 1.0, 10)])
def test_sample_size(n, fraction, expected):
    assert perturb.sample_size(n, fraction) == expected


def test_report_with_non_finite_values(six):
    inf = float("inf")
    odd = six.withColumn("dti", F.when(F.col("loan_id") == "a", inf).when(
        F.col("loan_id") == "b", -inf).otherwise(F.col("dti")))
    frame, report = perturb.perturb_with_report(odd, [perturb.Shift("dti", 5.0)])
    row = report.first()
    assert (row["eligible_rows"], row["selected_rows"], row["changed_rows"]) == (4, 4, 4)
    assert (row["before_non_finite_count"], row["before_finite_count"]) == (2, 4)
    assert row["before_mean"] == 45 and row["after_mean"] == 50
    assert row["after_median"] == 50
    assert {r["dti"] for r in frame.filter("loan_id IN ('a', 'b')").collect()} == {inf, -inf}


def test_perturb_checks(six):
    with pytest.raises(DataContractError):
        perturb.Shift("annual_inc", 1.0)
    with pytest.raises(DataContractError):
        perturb.Shift("dti", math.inf)
    with pytest.raises(DataContractError):
        perturb.Shift("dti", 1.0, lower=2.0, upper=1.0)
    with pytest.raises(DataContractError, match="protected"):
        perturb.apply_shifts(six, [perturb.Shift("dti", 1.0)], protected=("dti",))
    with pytest.raises(DataContractError, match="seed"):
        perturb.apply_shifts(six, [], seed=-1)
    with pytest.raises(DataContractError, match="numeric"):
        perturb.apply_shifts(
            six.withColumn("dti", F.lit("x")), [perturb.Shift("dti", 1.0)])


def test_simulation_end_to_end(spark, written, tmp_path):
    root, *_ = written
    result = simulate.simulate(
        spark, root, window=TimeWindow("2016-01-01", "2017-01-01"),
        shifts=[perturb.Shift("int_rate", 1.0)], seed=1)
    out = str(tmp_path / "out")
    result.write(out)
    assert result.summary["rows_selected"] == 4
    before = store.read_store(spark, root).filter("issue_quarter < '2017'").agg(
        F.sum("int_rate")).first()[0]
    after = spark.read.parquet(out).agg(F.sum("int_rate")).first()[0]
    assert after == pytest.approx(before + 4)


def test_contract_finds_each_bad_feature(spark):
    rows = [(1.0, 1), (None, 1), (1.0, None), (float("nan"), 1), (float("-inf"), None)]
    view = spark.createDataFrame(rows, "f double, g int").selectExpr(
        "1L AS loan_id", "timestamp '2018-02-01' AS issue_d", "'2018Q1' AS issue_quarter",
        "'train' AS dataset_split", "1 AS target", "f", "g")
    assert store.contract_counts(view).first()["bad_feature"] == 4


def test_scaled_rows_are_written_without_a_shuffle(spark, tmp_path):
    view = spark.range(1000).selectExpr(
        "id AS loan_id", "timestamp '2018-02-01' AS issue_d",
        "concat('2018Q', 1 + id % 4) AS issue_quarter", "'train' AS dataset_split",
        "1 AS target", "id * 0.5 AS f")
    store.write_view(view, f"{tmp_path}/first", "errorifexists")
    read = spark.read.parquet(f"{tmp_path}/first")
    store.write_view(read, f"{tmp_path}/second", "errorifexists", placed=True)
    again = spark.read.parquet(f"{tmp_path}/second")
    assert store.content_difference(read, again).isEmpty()
    assert len(again.inputFiles()) == len(read.inputFiles()) == 4
