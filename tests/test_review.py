"""Review analytics and rules on small hand-made tables."""

import random

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.operators import attributions, review, rules

SAMPLE = {
    "annual_inc": "75000", "dti": "16.5", "revol_util": "38%", "revol_bal": "28000",
    "open_acc": "10", "total_acc": "22", "delinq_2yrs": "0", "inq_last_6mths": "1",
    "loan_amnt": "12000", "term": "36 months", "int_rate": "11.2%", "installment": "395",
    "grade": "B", "sub_grade": "B3", "purpose": "debt_consolidation", "emp_length": "5 years",
    "home_ownership": "MORTGAGE", "earliest_cr_line": "Jan-2004", "issue_d": "Jan-2018",
}


def broken_fields(spark, **changes):
    row = {**SAMPLE, **changes}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    found = rules.check_applications(frame).first()["violations"]
    return [v["field"] for v in found]


def test_sample_application_is_sound(spark):
    assert broken_fields(spark) == []
    assert broken_fields(spark, emp_length="n/a", earliest_cr_line="") == []
    assert broken_fields(spark, annual_inc=None, grade=None, purpose=None) == []


@pytest.mark.parametrize("changes, expected", [
    ({"dti": "1001"}, ["dti"]), ({"loan_amnt": "0"}, ["loan_amnt"]), ({"term": "48"}, ["term"]),
    ({"emp_length": "120 years"}, ["emp_length"]), ({"emp_length": "long"}, ["emp_length"]),
    ({"int_rate": "101%"}, ["int_rate"]), ({"revol_util": "999%"}, []),
    ({"revol_util": "1001"}, ["revol_util"]), ({"grade": "H", "sub_grade": None}, ["grade"]),
    ({"sub_grade": "B6"}, ["sub_grade"]), ({"sub_grade": "C1"}, ["sub_grade"]),
    ({"purpose": "yacht"}, ["purpose"]), ({"purpose": "Credit Card"}, []),
    ({"home_ownership": "boat"}, ["home_ownership"]), ({"issue_d": None}, ["issue_d"]),
    ({"earliest_cr_line": "someday"}, ["earliest_cr_line"]),
    ({"earliest_cr_line": "Feb-2018"}, ["earliest_cr_line"]), ({"annual_inc": "-1"}, ["annual_inc"]),
])
def test_application_rules(spark, changes, expected):
    assert broken_fields(spark, **changes) == expected


@pytest.mark.parametrize("value, expected", [
    ("n.a.", "must be a number or percentage"), ("", "must be a number or percentage"),
    ("-1%", "must be between 0 and 1000"), ("1000.5", "must be between 0 and 1000"),
    ("100.5", "must be between 0 and 100"), ("1000 %", "must be between 0 and 100"),
    ("100", None), (None, None),
])
def test_percent_messages_and_counts(spark, value, expected):
    row = {**SAMPLE, "int_rate": value}
    schema = ", ".join(f"{c} string" for c in row)
    broken = {**row, "loan_amnt": "0"}
    frame = spark.createDataFrame([tuple(row.values()), tuple(broken.values())], schema)
    found = [v for r in rules.check_applications(frame).collect() for v in r["violations"]]
    assert [v["message"] for v in found if v["field"] == "int_rate"] == (
        [f"int_rate {expected}"] * 2 if expected else [])
    counts = {(r["field"], r["message"]): r["violations"]
              for r in rules.violation_counts(frame).collect()}
    assert counts == Counter((v["field"], v["message"]) for v in found)


def test_counts_clean_each_text_once_and_read_once(spark):
    frame = spark.createDataFrame([tuple(SAMPLE.values())], ", ".join(f"{c} string" for c in SAMPLE))
    assert rules.violation_counts(frame).collect() == []
    assert rules.violation_counts(frame.limit(0)).collect() == []
    plan = rules.violation_counts(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "size(array" not in plan


def test_warnings(spark):
    frame = spark.createDataFrame(
        [("150", "11.2%", "about half")], "dti string, int_rate string, revol_util string")
    found = rules.soft_warnings(frame).first()["warnings"]
    assert [w["field"] for w in found] == ["dti", "revol_util"]


def tables(spark):
    applications = spark.createDataFrame(
        [(1, "Ref One", 10, "2024-01-01"), (2, "Ref Two", 11, "2024-01-02"),
         (3, "Other", 10, "2024-01-03"), (4, "Fourth", 11, "2024-01-03")],
        "application_id int, external_reference string, created_by_id int, at string"
    ).withColumn("created_at", F.to_timestamp("at")).drop("at")
    predictions = spark.createDataFrame(
        [(100, 1, 10, 0.2, False, "2024-02-01"), (101, 1, 10, 0.7, True, "2024-02-01"),
         (102, 2, 11, 1.0, True, "2024-02-02"), (103, 3, 10, 0.4, False, "2024-02-03")],
        "prediction_id int, application_id int, requested_by_id int, score double, "
        "risk_flag boolean, at string").withColumn("created_at", F.to_timestamp("at")).drop("at")
    feedback = spark.createDataFrame(
        [(1, 101, 1, "approve", True, None), (2, 101, 2, "escalate", False, "x"),
         (3, 102, 1, "decline", None, None), (4, 100, 1, "approve", True, None)],
        "feedback_id int, prediction_id int, version int, decision string, "
        "agreed_with_model boolean, note string").withColumn(
        "created_at", F.to_timestamp(F.lit("2024-03-01")))
    return applications, predictions, feedback


def test_status_and_listing(spark):
    a, p, f = tables(spark)
    statuses = review.application_status(a, p, f)
    rows = {r["application_id"]: (r["latest_prediction_id"], r["status"]) for r in statuses.collect()}
    assert rows == {1: (101, "escalated"), 2: (102, "decided"), 3: (103, "scored"),
                    4: (None, "unscored")}
    listed = review.filter_applications(statuses, search="ref")
    page = review.page(listed, [F.col("created_at").desc(), F.col("application_id").desc()], 1, 1)
    row = review.with_total(listed, page).first()
    assert (row["application_id"], row["total"]) == (1, 2)
    assert review.filter_applications(statuses, risk_flag=True).count() == 2
    assert review.filter_applications(statuses, date_from="2024-01-02",
                                      date_to="2024-01-02").count() == 1
    with pytest.raises(DataContractError):
        review.filter_applications(statuses, status="lost")


@pytest.mark.parametrize("status, expected", [
    ("pending", {103}), ("decided", {100, 101, 102}), ("approve", {100}), ("escalate", {101})])
def test_prediction_filters(spark, status, expected):
    _, p, f = tables(spark)
    got = {r["prediction_id"] for r in
           review.filter_predictions(p, f, decision_status=status).collect()}
    assert got == expected


def test_current_versions(spark):
    *_, f = tables(spark)
    marked = {r["feedback_id"]: r["is_current"] for r in review.mark_current(f).collect()}
    assert marked == {1: False, 2: True, 3: True, 4: True}
    chain = {r["feedback_id"]: r["amends_feedback_id"] for r in rules.amendment_chain(f).collect()}
    assert chain == {1: None, 2: 1, 3: None, 4: None}


def test_dashboard(spark):
    a, p, f = tables(spark)
    nothing = spark.createDataFrame(
        [], "snapshot_id int, status string, created_at timestamp, ticket_id int")
    row = review.dashboard_summary(a, p, f, nothing, nothing).first()
    assert (row["applications"], row["scored"], row["decided"], row["pending"]) == (4, 3, 2, 1)
    assert row["risk_flag_rate"] == pytest.approx(2 / 3)
    assert (row["approve_count"], row["decline_count"], row["escalate_count"]) == (0, 1, 1)
    assert (row["agreement_rate"], row["override_rate"]) == (0.0, 1.0)
    assert (row["latest_drift_status"], row["open_tickets"]) == ("not_observed", 0)
    own = review.dashboard_summary(a, p, f, nothing, nothing, owner_id=10).first()
    assert (own["applications"], own["scored"], own["decided"]) == (2, 2, 1)
    bins = {r["bin"]: r["count"] for r in review.score_histogram(a, p).collect()}
    assert bins == {7: 1, 9: 1, 4: 1}


def test_arms_are_always_present(spark):
    _, p, f = tables(spark)
    exposed = review.exposures(p).withColumn("variant", F.lit(S.ARM_SHOWN))
    rows = {r["variant"]: r for r in review.experiment_arms(exposed, f).collect()}
    assert (rows[S.ARM_SHOWN]["exposures"], rows[S.ARM_SHOWN]["decisions"]) == (4, 3)
    assert rows[S.ARM_SHOWN]["agreement_rate"] == 0.5
    assert rows[S.ARM_SCORE_ONLY]["exposures"] == 0
    assert rows[S.ARM_SCORE_ONLY]["agreement_rate"] is None


def test_study_arm_follows_digest_parity(spark):
    import hashlib

    from ledgerlens.functions import derive

    frame = spark.range(50).select(F.col("id").cast("string").alias("o"))
    for row in frame.select("o", derive.study_arm("o").alias("arm")).collect():
        even = hashlib.sha256(row["o"].encode()).digest()[0] % 2 == 0
        assert row["arm"] == (S.ARM_SHOWN if even else S.ARM_SCORE_ONLY)


def test_access(spark):
    _, p, _ = tables(spark)
    users = spark.createDataFrame(
        [(10, "loan_officer"), (11, "risk_analyst"), (12, "loan_officer")], "user_id int, role string")
    rows = {r["user_id"]: r["visible_records"] for r in review.access_counts(
        p, users, owner="requested_by_id", read_all="prediction:read_all").collect()}
    assert rows == {10: 3, 11: 4, 12: 0}
    seen = review.visible_to(p, user_id=10, role="loan_officer", owner="requested_by_id",
                             read_all="prediction:read_all")
    assert seen.count() == 3


def test_redaction_and_masking(spark):
    frame = spark.createDataFrame([({"Token": "x", "why": "y"}, S.ARM_SCORE_ONLY)],
                                  "m map<string,string>, arm string")
    assert frame.select(review.redact("m").alias("m")).first()["m"] == {"why": "y"}
    shown = frame.select("arm", F.lit(True).alias("explanation_available"),
                         F.lit("because").alias("narrative"),
                         F.array(F.lit("dti")).alias("top_features"))
    row = attributions.mask_explanation(shown, "arm").first()
    assert (row["explanation_available"], row["narrative"], row["top_features"]) == (
        False, S.WITHHELD_NARRATIVE, [])


def test_tickets(spark):
    alerts = spark.createDataFrame(
        [(1, "drift_detected", 1), (2, "drift_detected", 2), (3, "stable", 3)],
        "snapshot_id int, status string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    requests = spark.createDataFrame([(7, "open"), (8, "approved")], "ticket_id int, status string")
    assert {r["monitoring_snapshot_id"] for r in review.gate_tickets(requests, alerts).collect()} == {2}
    refused = review.gate_tickets(requests, alerts.filter("status = 'stable'")).collect()
    assert len(refused) == 2 and all(r["rejection"] for r in refused)
    reviewed = review.review_tickets(
        requests, spark.createDataFrame([(7, False), (8, False)], "ticket_id int, approve boolean"))
    rows = {r["ticket_id"]: (r["status"], r["rejection"] is None) for r in reviewed.collect()}
    assert rows == {7: ("rejected", True), 8: ("approved", False)}


def test_decision_intake_matches_one_by_one(spark):
    rng = random.Random(8)
    predictions = list(range(6))
    stored = [(1000 + i, p, 1 + i) for p in (0, 1) for i in range(p + 1)]
    incoming = [(i, rng.choice([0, 1, 2, 3, 3, 3, 4, 9]), rng.choice([None, True, False]),
                 rng.choice([None, "  ", "note"]), rng.randrange(20)) for i in range(150)]
    latest = {}
    for feedback_id, p, version in stored:
        latest[p] = (version, feedback_id, None)
    expected = {}
    for request, p, agreed, note, at in sorted(incoming, key=lambda r: (r[4], r[0])):
        text = (note or "").strip() or None
        if p not in predictions:
            expected[request] = (rules.UNKNOWN_PREDICTION, None, None, None)
        elif p in latest and text is None:
            expected[request] = (rules.AMEND_NEEDS_NOTE, None, None, None)
        elif agreed is False and text is None:
            expected[request] = (rules.OVERRIDE_NEEDS_NOTE, None, None, None)
        else:
            version, stored_id, earlier = latest.get(p, (0, None, None))
            expected[request] = (None, version + 1, stored_id, earlier)
            latest[p] = (version + 1, None, request)
    frame = spark.createDataFrame(
        [(r, p, "approve", a, n, t) for r, p, a, n, t in incoming],
        "request_id int, prediction_id int, decision string, agreed_with_model boolean, "
        "note string, created_at int").repartition(4)
    known = spark.createDataFrame([(p,) for p in predictions], "prediction_id int")
    feedback = spark.createDataFrame(
        [(f, p, v, 0) for f, p, v in stored],
        "feedback_id int, prediction_id int, version int, created_at int")
    got = {r["request_id"]: (r["rejection"], r["version"], r["amends_feedback_id"],
                             r["amends_request_id"])
           for r in rules.decision_intake(frame, known, feedback).collect()}
    assert got == expected
