"""CSV scans, inventories, audits and the command line, end to end."""

import gzip
import hashlib
import json
import os

import pytest

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.jobs import __main__ as cli
from ledgerlens.jobs import build
from ledgerlens.operators import models, store
from ledgerlens.sources import inventory, loans


@pytest.fixture
def csv_text(raw_loans):
    columns = raw_loans.columns
    lines = [",".join(columns)]
    for row in raw_loans.orderBy("loan_id").collect():
        lines.append(",".join("" if row[c] is None else str(row[c]) for c in columns))
    return lines


def write(path, lines, encoding="utf-8"):
    path.write_text("\n".join(lines) + "\n", encoding=encoding)
    return str(path)


def test_preamble_bom_gzip_and_order(spark, tmp_path, csv_text):
    plain = write(tmp_path / "b.csv", ["Notes offered by Prospectus"] + csv_text[:5])
    bom = write(tmp_path / "a.csv", [csv_text[0]] + csv_text[5:8], "utf-8-sig")
    zipped = tmp_path / "c.csv.gz"
    zipped.write_bytes(gzip.compress(("\n".join([csv_text[0]] + csv_text[8:]) + "\n").encode()))
    paths = [plain, str(zipped), bom]
    rows = loans.allowed_loans(spark, paths, keep=("loan_id",)).collect()
    assert sorted(int(r["loan_id"]) for r in rows) == list(range(9))
    layout = loans.find_layout(spark, plain)
    assert layout.header_line == 1
    assert layout.ignored == ["last_pymnt_d", "recoveries", "total_pymnt"]
    facts = {r["file"].split("/")[-1]: r for r in loans.source_inventory(spark, paths).collect()}
    assert facts["b.csv"]["rows_read"] == 4 and facts["b.csv"]["header_rows_skipped"] == 1
    assert facts["a.csv"]["sha256"] == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()


def test_archive_header_matches(spark, tmp_path, csv_text):
    plain = write(tmp_path / "x.csv", ["a preamble"] + csv_text)
    zipped = tmp_path / "x.csv.gz"
    zipped.write_bytes(gzip.compress("\n".join(csv_text).encode()))
    assert loans.require_same_header(spark, str(zipped), plain) == len(csv_text[0].split(","))
    other = write(tmp_path / "y.csv", [csv_text[0] + ",more"])
    with pytest.raises(DataContractError, match="differ"):
        loans.require_same_header(spark, str(zipped), other)


def test_report_sink(spark, tmp_path):
    frame = spark.createDataFrame([("2018Q2", 2), ("2018Q1", 1)], "issue_quarter string, loans int")
    inventory.write_report(frame, str(tmp_path / "report"), ["issue_quarter"])
    text, = (p.read_text() for p in (tmp_path / "report").glob("*.csv"))
    assert text.split() == ["issue_quarter,loans", "2018Q1,1", "2018Q2,2"]


def test_quoted_newlines_and_short_rows(spark, tmp_path, csv_text):
    quoted = csv_text[1].replace("debt_consolidation", '"debt\nconsolidation"')
    short = ",".join(csv_text[2].split(",")[:5])
    path = write(tmp_path / "a.csv", [csv_text[0], quoted, short])
    rows = {r["loan_id"]: r for r in loans.allowed_loans(spark, [path], keep=("loan_id",)).collect()}
    assert loans.files_with_open_quotes(spark, [path]) == set(loans.input_files(spark, [path]))
    assert rows["0"]["purpose"] == "debt\nconsolidation"
    assert rows["1"]["issue_d"] is None and len(rows) == 2


def test_every_way_to_name_a_file(spark, tmp_path, csv_text):
    folder = tmp_path / "sp ace [1] 100%"
    folder.mkdir()
    quoted = csv_text[1].replace("debt_consolidation", '"debt\nconsolidation"')
    path = write(folder / "a b.csv", ["a preamble,,", csv_text[0], quoted, csv_text[2]])
    plain = tmp_path / "plain"
    plain.mkdir()
    write(plain / "a.csv", ["a preamble,,", csv_text[0], quoted, csv_text[2]])
    escaped = path.replace("[", "\\[").replace("]", "\\]")
    relative = os.path.relpath(plain / "a.csv")
    for named in ([relative], [str(plain / "a.csv")], [str(plain)], [str(plain / "*.csv")], [escaped],
                  [f"file://{plain}/a.csv"]):
        rows = loans.allowed_loans(spark, named, keep=("loan_id",)).collect()
        assert sorted(r["loan_id"] for r in rows) == ["0", "1"], named
        assert {r["purpose"] for r in rows} >= {"debt\nconsolidation"}
        fact, = loans.source_inventory(spark, named).collect()
        assert fact["rows_read"] == 2 and fact["bytes"] > 0, named


def test_loan_ids_do_not_depend_on_the_split(spark, tmp_path, csv_text):
    lines = [line.split(",", 1)[1] for line in csv_text]
    path = write(tmp_path / "noid.csv", [*lines, *lines[1:] * 30])
    found = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = build.with_loan_id(loans.scan_loans(spark, [path])).collect()
        found.append(sorted((r["loan_id"], r["dti"]) for r in rows))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({i for i, _ in found[0]}) == len(found[0])


def test_scan_errors(spark, tmp_path, csv_text):
    long = write(tmp_path / "long.csv", [csv_text[0], csv_text[1] + ",one,two"])
    with pytest.raises(DataContractError, match="more fields"):
        loans.allowed_loans(spark, [long])
    blank = write(tmp_path / "blank.csv", [csv_text[0], csv_text[1] + ","])
    with pytest.raises(DataContractError, match="more fields"):
        loans.allowed_loans(spark, [blank])
    headless = write(tmp_path / "none.csv", ["a,b", "1,2"])
    with pytest.raises(DataContractError, match="no header"):
        loans.scan_loans(spark, [headless])
    twice = write(tmp_path / "twice.csv", [csv_text[0] + ",dti", csv_text[1] + ",1"])
    with pytest.raises(DataContractError, match="duplicate column"):
        loans.scan_loans(spark, [twice])
    empty = write(tmp_path / "empty.csv", [csv_text[0]])
    with pytest.raises(DataContractError, match="zero rows"):
        loans.allowed_loans(spark, [empty])
    with pytest.raises(DataContractError, match="duplicate CSV"):
        loans.scan_loans(spark, [empty, empty])


def test_missing_tokens_become_null(spark, tmp_path, csv_text):
    spoiled = csv_text[1].replace("60000", "#N/A").replace("RENT", "None")
    rows = loans.allowed_loans(spark, [write(tmp_path / "a.csv", [csv_text[0], spoiled])]).collect()
    assert rows[0]["annual_inc"] is None and rows[0]["home_ownership"] is None


def test_cohorts(spark, tmp_path):
    csv_path = write(tmp_path / "c.csv", ["dti,rate", "1,2", "3,4"])
    json_path = tmp_path / "c.json"
    json_path.write_text(json.dumps([{"dti": 1, "rate": 2}, {"dti": 3, "rate": 4}]))
    assert loans.read_cohort(spark, csv_path).count() == 2
    assert loans.read_cohort(spark, str(json_path)).count() == 2
    with pytest.raises(DataContractError, match="header"):
        loans.read_cohort(spark, write(tmp_path / "h.csv", ["dti,", "1,2"]))
    narrow = loans.read_cohort(spark, write(tmp_path / "n.csv", ["dti,rate", "1"]))
    with pytest.raises(Exception):
        narrow.collect()


def test_acquisition_audit(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.csv").write_text("abc")
    digest = hashlib.sha256(b"abc").hexdigest()

    def row(source, name="data/x.csv", size="3", sha=digest, when="2024", status="acquired_verified"):
        return (source, "r", "", "1", when, name, size, sha, name, size, sha.upper(), "l", status)

    schema = ", ".join(f"{c} string" for c in inventory.MANIFEST_COLUMNS)
    listed = inventory.files(spark, str(tmp_path), "*.csv")
    assert [r["name"] for r in listed.collect()] == ["data/x.csv"]

    def problems(*rows):
        found = inventory.acquisition_audit(spark.createDataFrame(list(rows), schema), listed)
        return {(r["source_id"], r["problem"].split(": ")[-1]) for r in found.collect()}

    assert problems(row("a")) == set()
    assert problems(row("a", size="4")) == {("a", "size mismatch")}
    assert problems(row("a", sha="0" * 64)) == {("a", "digest mismatch")}
    assert problems(row("a", name="../x.csv")) == {("a", "path escapes the root")}
    assert problems(row("a", name="y.csv")) == {("a", "file is missing")}
    assert problems(row("a", when="")) == {("a", "missing acquisition timestamp")}
    assert problems(row("a"), row("a", status="planned")) == {("a", "duplicate source_id")}
    assert problems(row("a", name="y.csv", status="planned")) == set()
    digests = [inventory.inventory_digest(listed).first()["digest"] for _ in range(2)]
    assert digests[0] == digests[1]


def test_text_structure(spark):
    lines = [" ".join(["A"] * 20 + ["1" if i < 700 else "2"]) for i in range(1000)] + ["  "]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    inventory.require_structure(frame)
    with pytest.raises(DataContractError):
        inventory.require_structure(frame.limit(900))
    unknown = spark.createDataFrame([(lines[0].replace("A", "?", 1),)], "value string")
    assert inventory.text_structure(unknown).first()["missing_fields"] == 1


def test_export(spark, tmp_path):
    users = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "user_id int, t string").selectExpr(
        "user_id", "to_timestamp(t) AS created_at")
    inventory.export_tables({"users": users}, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out" / "users")).first()["value"])
    assert line == {"user_id": 1, "created_at": "2024-01-01T00:00:00.000000Z"}
    with pytest.raises(DataContractError):
        inventory.export_tables({"other": users}, str(tmp_path / "o2"))


def test_command_line_end_to_end(spark, tmp_path, csv_text):
    # Four copies with shifted ids keep both classes in every window.
    header, body = csv_text[0], csv_text[1:]
    flip = {"Fully Paid": "Charged Off", "Charged Off": "Fully Paid", "Default": "Fully Paid",
            "Current": "Current"}
    lines = [header]
    for copy in range(4):
        for line in body:
            parts = line.split(",")
            parts[0] = str(int(parts[0]) + 100 * copy)
            status = header.split(",").index("loan_status")
            if copy % 2:
                parts[status] = flip[parts[status]]
            lines.append(",".join(parts))
    source = write(tmp_path / "loans.csv", lines)
    root, out = str(tmp_path / "store"), str(tmp_path / "models")

    def run(*argv):
        return cli.run(spark, cli.parser().parse_args(list(argv)))

    built = run("build", "--input", source, "--feature-store", root)
    assert built["row_counts"] == {"train": 16, "validation": 4, "shift": 12}
    assert run("validate", root)["status"] == "passed"
    again = str(tmp_path / "again")
    run("build", "--input", source, "--feature-store", again)
    assert run("compare", root, again)["status"] == "passed"
    simulated = run("simulate-drift", root, "--output", str(tmp_path / "sim"), "--start",
                    "2017-01-01", "--dti-shift", "0.5", "--dti-mode", "relative")
    assert simulated["rows_selected"] == 16
    config = models.TrainingConfig(
        cv_folds=1, candidates={"logistic_regression": ({"maxIter": 5},)})
    from ledgerlens.jobs import train

    found = train.train(spark, root, out, config=config)
    assert set(found) == {"logistic_regression"}
    assert spark.read.parquet(f"{out}/detector").first()["score_stream_count"] == 4
    scored = run("score", f"{out}/logistic_regression", "--input", source, "--output",
                 str(tmp_path / "scored"))
    assert spark.read.parquet(scored["output"]).count() == 36
    ref = write(tmp_path / "ref.csv", ["dti"] + [str(i) for i in range(30)])
    cur = write(tmp_path / "cur.csv", ["dti"] + [str(100 + i) for i in range(30)])
    checked = run("drift-check", ref, cur, "--output", str(tmp_path / "snapshots"))
    assert (checked["status"], checked["feature_drift_count"]) == ("drift_detected", 1)
    statuses = dict(spark.read.parquet(f"{root}/status_inventory").collect())
    assert statuses["current"] == 4
    assert store.read_manifest(spark, root)["pipeline_metadata"]["statuses"] == len(statuses)
    assert S.QUARTER in store.read_store(spark, root).columns
