"""Queries over applications, predictions, decisions, tickets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import derive, parse
from ledgerlens.operators import adwin, attributions, drift, review, rules
from ledgerlens.plans import oracle as O
from ledgerlens.plans.inputs import Inputs, longs, rounded, text_time
from ledgerlens.plans.registry import Registry

QUERIES = Registry()
query = QUERIES.add

_AT = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


@query("latest_predictions", """
SELECT application_id, prediction_id, round(score, 6) AS score, risk_flag
FROM latest_prediction""")
def latest_predictions(x: Inputs) -> DataFrame:
    return review.latest_predictions(x.view("predictions")).select(
        "application_id", "prediction_id", *rounded("score"), "risk_flag")


@query("current_decisions", """
SELECT prediction_id, feedback_id, CAST(version AS BIGINT) AS version, decision
FROM latest_feedback""")
def current_decisions(x: Inputs) -> DataFrame:
    return review.current_decisions(x.view("feedback")).select(
        "prediction_id", "feedback_id", *longs("version"), "decision")


@query("dedupe_latest", """
SELECT prediction_id, feedback_id FROM (SELECT prediction_id, feedback_id,
  row_number() OVER (PARTITION BY prediction_id
    ORDER BY version DESC, created_at DESC, feedback_id DESC) AS rn
  FROM (SELECT * FROM feedback UNION ALL
    SELECT feedback_id + 1000000000, prediction_id, version, decision, agreed_with_model, note,
      created_at FROM feedback)) WHERE rn = 1""")
def dedupe_latest(x: Inputs) -> DataFrame:
    """Every decision delivered twice under two ids; one kept per prediction."""
    feedback = x.view("feedback")
    repeated = feedback.withColumn("feedback_id", F.col("feedback_id") + 1_000_000_000)
    return review.dedupe_latest(feedback.unionByName(repeated)).select(
        "prediction_id", "feedback_id")


@query("latest_scored", """
SELECT a.application_id, p.prediction_id, round(p.score, 6) AS score, p.risk_flag,
  CAST(a.created_by_id AS BIGINT) AS created_by_id
FROM latest_prediction p JOIN applications a USING (application_id)""")
def latest_scored(x: Inputs) -> DataFrame:
    return review.latest_scored(x.view("applications"), x.view("predictions")).select(
        "application_id", "prediction_id", *rounded("score"), "risk_flag",
        *longs("created_by_id"))


def _statuses(x: Inputs) -> DataFrame:
    return review.application_status(
        x.view("applications"), x.view("predictions"), x.view("feedback"))


_STATUS_COLUMNS = ("application_id, external_reference, " + _AT + ", latest_prediction_id, "
                   "round(score, 6) AS score, risk_flag, current_decision, status")


def _status_columns(df: DataFrame) -> list:
    return ["application_id", "external_reference", text_time("created_at"),
            "latest_prediction_id", *rounded("score"), "risk_flag", "current_decision", "status"]


@query("application_status", f"SELECT {_STATUS_COLUMNS} FROM statuses")
def application_status(x: Inputs) -> DataFrame:
    statuses = _statuses(x)
    return statuses.select(*_status_columns(statuses))


@query("applications_list", f"""
SELECT {_STATUS_COLUMNS}, count(*) OVER () AS total FROM (SELECT * FROM statuses
  WHERE (external_reference ILIKE '%1%' OR CAST(application_id AS VARCHAR) ILIKE '%1%')
    AND created_at >= TIMESTAMP '1995-02-01' AND created_at <= TIMESTAMP '1997-12-31'
    AND status = 'decided') s
ORDER BY s.created_at DESC, application_id DESC LIMIT 50 OFFSET 10""")
def applications_list(x: Inputs) -> DataFrame:
    listing = review.filter_applications(
        _statuses(x), search=" 1 ", status="decided",
        date_from="1995-02-01", date_to="1997-12-31")
    paged = review.page(
        listing, [F.col("created_at").desc(), F.col("application_id").desc()], 50, 10)
    return review.with_total(listing, paged).select(*_status_columns(paged), "total")


@query("recent_applications", f"""
SELECT {_STATUS_COLUMNS} FROM statuses s
ORDER BY s.created_at DESC, application_id DESC LIMIT 5""")
def recent_applications(x: Inputs) -> DataFrame:
    recent = review.recent_applications(_statuses(x))
    return recent.select(*_status_columns(recent))


@query("predictions_list", f"""
SELECT p.prediction_id, p.application_id, round(p.score, 6) AS score, {_AT.replace('(created', '(p.created')}
FROM predictions p JOIN latest_feedback f USING (prediction_id)
WHERE f.decision = 'escalate' AND p.risk_flag
ORDER BY p.created_at DESC, p.prediction_id DESC LIMIT 100""")
def predictions_list(x: Inputs) -> DataFrame:
    listing = review.filter_predictions(
        x.view("predictions"), x.view("feedback"), risk_flag=True, decision_status=" Escalate ")
    return review.page(
        listing, [F.col("created_at").desc(), F.col("prediction_id").desc()], 100
    ).select("prediction_id", "application_id", *rounded("score"), text_time("created_at"))


@query("feedback_list", f"""
SELECT feedback_id, prediction_id, CAST(version AS BIGINT) AS version, decision, {_AT}, is_current
FROM (SELECT *, version = max(version) OVER (PARTITION BY prediction_id) AS is_current
  FROM feedback) f
WHERE decision = 'decline' AND created_at >= TIMESTAMP '1996-01-01'
ORDER BY f.created_at DESC, feedback_id DESC LIMIT 200""")
def feedback_list(x: Inputs) -> DataFrame:
    listing = review.filter_feedback(
        x.view("feedback"), decision="decline", date_from="1996-01-01")
    return review.page(
        listing, [F.col("created_at").desc(), F.col("feedback_id").desc()], 500
    ).select("feedback_id", "prediction_id", *longs("version"), "decision",
             text_time("created_at"), "is_current")


@query("audit_list", f"""
SELECT a.audit_id, CAST(a.actor_user_id AS BIGINT) AS actor_user_id, u.username AS actor_username,
  a.action, {_AT.replace('(created', '(a.created')}
FROM audit_events a LEFT JOIN users u ON u.user_id = a.actor_user_id
WHERE a.action = 'click' AND (u.username ILIKE '%NATION_1%' OR a.actor_user_id = 30)
ORDER BY a.created_at DESC, a.audit_id DESC LIMIT 150""")
def audit_list(x: Inputs) -> DataFrame:
    events, users = x.view("audit_events"), x.view("users")
    by_name = review.filter_audit(events, users, action="click", actor="nation_1")
    by_id = review.filter_audit(events, users, action="click", actor="30")
    return review.page(
        by_name.unionByName(by_id), [F.col("created_at").desc(), F.col("audit_id").desc()], 150
    ).select("audit_id", *longs("actor_user_id"), "actor_username", "action",
             text_time("created_at"))


@query("users_list", """
SELECT CAST(user_id AS BIGINT) AS user_id, username, role, is_active FROM users
WHERE username ILIKE '%nation_1%' AND is_active ORDER BY username LIMIT 50""")
def users_list(x: Inputs) -> DataFrame:
    listing = review.filter_users(x.view("users"), search="nation_1", active=True)
    return review.page(listing, [F.col("username")]).select(
        *longs("user_id"), "username", "role", "is_active")


def _catalogue() -> str:
    return " UNION ALL ".join(
        f"SELECT '{role}' AS role, '{code}' AS permission"
        for role, codes in S.ROLE_PERMISSIONS.items() for code in codes)


@query("role_permissions", f"""
SELECT CAST(u.user_id AS BIGINT) AS user_id, u.role, c.permissions, c.permission_count
FROM users u JOIN (SELECT role, string_agg(permission, ',' ORDER BY permission) AS permissions,
  count(*) AS permission_count FROM ({_catalogue()}) GROUP BY role) c USING (role)""")
def role_permissions(x: Inputs) -> DataFrame:
    return review.role_permissions(x.view("users")).select(
        *longs("user_id"), "role", "permissions", "permission_count")


@query("row_access", """
SELECT CAST(u.user_id AS BIGINT) AS user_id, u.role, u.role <> 'loan_officer' AS reads_all,
  CASE WHEN u.role <> 'loan_officer' THEN (SELECT count(*) FROM predictions)
    ELSE coalesce(o.own, 0) END AS visible_records
FROM users u LEFT JOIN (SELECT requested_by_id, count(*) AS own FROM predictions
  GROUP BY requested_by_id) o ON o.requested_by_id = u.user_id""")
def row_access(x: Inputs) -> DataFrame:
    return review.access_counts(
        x.view("predictions"), x.view("users"), owner="requested_by_id",
        read_all="prediction:read_all",
    ).select(*longs("user_id"), "role", "reads_all", "visible_records")


def _rules_sql() -> str:
    def text(c):
        return f"trim({c})"

    def plain(t):
        return f"(CASE WHEN regexp_matches({t}, '{O.NUMBER}') THEN CAST({t} AS DOUBLE) END)"

    def outside(t, low, high):
        return f"({plain(t)} IS NULL OR {plain(t)} < {low} OR {plain(t)} > {high})"

    parts = []

    def rule(test, field, message):
        parts.append(
            f"SELECT '{field}' AS field, '{message.replace(chr(39), chr(39) * 2)}' AS message, "
            f"count(*) AS violations FROM loans_raw WHERE {test}")

    for c, (low, high) in rules.RANGES.items():
        test = f"{c} IS NOT NULL AND {outside(text(c), low, high)}"
        if c == "loan_amnt":
            test = f"({test}) OR {plain(text(c))} = 0"
        rule(test, c, rules.MESSAGES["number"])
    for c in ("revol_util", "int_rate"):
        bare = plain(f"trim(rtrim({text(c)}, '%'))")
        rule(f"{c} IS NOT NULL AND {bare} IS NULL", c, rules.MESSAGES[f"{c}_text"])
        rule(f"{bare} < 0 OR {bare} > 1000", c, rules.MESSAGES[f"{c}_range"])
    rule(f"{bare} > 100 AND {bare} <= 1000", "int_rate", rules.MESSAGES["int_rate"])
    rule(f"lower(trim(term)) NOT IN {O.quoted(rules.TERMS)}", "term", rules.MESSAGES["term"])
    stated = ("emp_length IS NOT NULL AND lower(trim(emp_length)) NOT IN "
              + O.quoted(rules.NO_EMPLOYMENT + rules.UNDER_ONE_YEAR))
    years = "regexp_replace(replace(lower(trim(emp_length)), '+', ''), ' years?$', '')"
    rule(f"{stated} AND {plain(years)} IS NULL", "emp_length", rules.MESSAGES["emp_length_text"])
    rule(f"{stated} AND ({plain(years)} < 0 OR {plain(years)} > 100)", "emp_length",
         rules.MESSAGES["emp_length_range"])
    rule("NOT regexp_matches(upper(trim(grade)), '^[A-G]$')", "grade", rules.MESSAGES["grade"])
    rule("NOT regexp_matches(upper(trim(sub_grade)), '^[A-G][1-5]$')", "sub_grade",
         rules.MESSAGES["sub_grade"])
    rule(f"replace(lower(trim(purpose)), ' ', '_') NOT IN {O.quoted(S.PURPOSES)}", "purpose",
         rules.MESSAGES["purpose"])
    rule(f"replace(upper(trim(home_ownership)), ' ', '_') NOT IN {O.quoted(S.HOME_OWNERSHIP)}",
         "home_ownership", rules.MESSAGES["home_ownership"])
    rule(f"({O.date('issue_d')}) IS NULL", "issue_d", rules.MESSAGES["issue_d"])
    rule("earliest_cr_line IS NOT NULL AND lower(trim(earliest_cr_line)) NOT IN "
         f"{O.quoted(rules.NO_EMPLOYMENT)} AND ({O.date('earliest_cr_line')}) IS NULL",
         "earliest_cr_line", rules.MESSAGES["earliest_cr_line"])
    rule(f"({O.date('earliest_cr_line')}) > ({O.date('issue_d')})", "earliest_cr_line",
         rules.MESSAGES["date_order"])
    rule("upper(trim(grade)) <> substr(upper(trim(sub_grade)), 1, 1)", "sub_grade",
         rules.MESSAGES["grade_order"])
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE violations > 0"


@query("application_rules", _rules_sql())
def application_rules(x: Inputs) -> DataFrame:
    return rules.violation_counts(x.loans())


@query("application_warnings", """
SELECT field, count(*) AS warnings FROM (
  SELECT 'dti' AS field FROM loans_raw WHERE loan_id % 3 = 0 AND CAST(dti AS DOUBLE) * 3 > 100
  UNION ALL SELECT 'int_rate' FROM loans_raw WHERE loan_id % 4 = 0 AND int_rate IS NOT NULL
  UNION ALL SELECT 'revol_util' FROM loans_raw WHERE revol_util IS NOT NULL AND loan_id % 5 = 0)
GROUP BY field""")
def application_warnings(x: Inputs) -> DataFrame:
    """Loans with some values scaled up or spelled oddly."""
    def when(step: int, changed, column: str):
        return F.when(F.col("loan_id") % step == 0, changed).otherwise(F.col(column))

    odd = x.loans().select(
        "loan_id",
        F.when(F.col("loan_id") % 3 == 0, (F.col("dti").cast("double") * 3).cast("string"))
        .otherwise("0").alias("dti"),
        when(4, F.concat(F.col("int_rate"), F.lit(" p.a.")), "int_rate").alias("int_rate"),
        when(5, F.concat(F.lit("ca. "), F.col("revol_util")), "revol_util").alias("revol_util"),
    )
    return rules.warning_counts(odd)


@query("ab_assignment", f"""
SELECT c_custkey AS officer_id,
  CASE WHEN CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 2)) AS INTEGER) % 2 = 0
    THEN '{S.ARM_SHOWN}' ELSE '{S.ARM_SCORE_ONLY}' END AS variant FROM customer""")
def ab_assignment(x: Inputs) -> DataFrame:
    return x.table("customer").select(
        F.col("c_custkey").alias("officer_id"), derive.study_arm("c_custkey").alias("variant"))


_ARM = (f"CASE WHEN CAST(('0x' || substr(sha256(CAST(requested_by_id AS VARCHAR)), 1, 2)) AS INTEGER)"
        f" % 2 = 0 THEN '{S.ARM_SHOWN}' ELSE '{S.ARM_SCORE_ONLY}' END")


@query("mask_explanations", f"""
SELECT prediction_id, {_ARM} = '{S.ARM_SHOWN}' AS explanation_available,
  CASE WHEN {_ARM} = '{S.ARM_SHOWN}' THEN 'Score of application ' || CAST(application_id AS VARCHAR)
    ELSE '{S.WITHHELD_NARRATIVE}' END AS narrative,
  CASE WHEN {_ARM} = '{S.ARM_SHOWN}' THEN CAST(1 AS BIGINT) ELSE 0 END AS features
FROM predictions""")
def mask_explanations(x: Inputs) -> DataFrame:
    explained = x.view("predictions").select(
        "prediction_id", "requested_by_id", F.lit(True).alias("explanation_available"),
        F.concat(F.lit("Score of application "), F.col("application_id").cast("string"))
        .alias("narrative"),
        F.array(F.struct(F.lit("score").alias("feature"))).alias("top_features"))
    masked = attributions.mask_explanation(explained, derive.study_arm("requested_by_id"))
    return masked.select("prediction_id", "explanation_available", "narrative",
                         F.size("top_features").cast("long").alias("features"))


@query("experiment_arms", f"""
SELECT v.variant, coalesce(e.exposures, 0) AS exposures, coalesce(e.decisions, 0) AS decisions,
  round(e.agreement_rate, 6) AS agreement_rate, round(e.override_rate, 6) AS override_rate
FROM (SELECT '{S.ARM_SHOWN}' AS variant UNION ALL SELECT '{S.ARM_SCORE_ONLY}') v
LEFT JOIN (SELECT {_ARM} AS variant, count(*) AS exposures, count(f.feedback_id) AS decisions,
  avg(CASE WHEN f.agreed_with_model THEN 1.0 WHEN NOT f.agreed_with_model THEN 0.0 END)
    AS agreement_rate,
  avg(CASE WHEN f.agreed_with_model THEN 0.0 WHEN NOT f.agreed_with_model THEN 1.0 END)
    AS override_rate
  FROM predictions p LEFT JOIN latest_feedback f ON f.prediction_id = p.prediction_id
  GROUP BY 1) e ON e.variant = v.variant""")
def experiment_arms(x: Inputs) -> DataFrame:
    arms = review.experiment_arms(review.exposures(x.view("predictions")), x.view("feedback"))
    return arms.select("variant", "exposures", "decisions",
                       *rounded("agreement_rate", "override_rate"))


@query("dashboard_summary", """
SELECT (SELECT count(*) FROM applications) AS applications, s.scored, d.decided,
  greatest(s.scored - d.decided, 0) AS pending, round(s.risk_flag_rate, 6) AS risk_flag_rate,
  d.approve_count, d.decline_count, d.escalate_count,
  round(d.agreement_rate, 6) AS agreement_rate, round(d.override_rate, 6) AS override_rate,
  (SELECT status FROM monitoring_snapshots ORDER BY created_at DESC, snapshot_id DESC LIMIT 1)
    AS latest_drift_status,
  (SELECT count(*) FROM retraining_tickets WHERE status = 'open') AS open_tickets
FROM (SELECT count(*) AS scored, avg(CASE WHEN risk_flag THEN 1.0 ELSE 0.0 END) AS risk_flag_rate
    FROM latest_prediction JOIN applications USING (application_id)) s,
  (SELECT count(*) AS decided, count(*) FILTER (decision = 'approve') AS approve_count,
      count(*) FILTER (decision = 'decline') AS decline_count,
      count(*) FILTER (decision = 'escalate') AS escalate_count,
      avg(CASE WHEN agreed_with_model THEN 1.0 WHEN NOT agreed_with_model THEN 0.0 END)
        AS agreement_rate,
      avg(CASE WHEN agreed_with_model THEN 0.0 WHEN NOT agreed_with_model THEN 1.0 END)
        AS override_rate
    FROM latest_feedback WHERE prediction_id IN (SELECT p.prediction_id
      FROM latest_prediction p JOIN applications USING (application_id))) d""")
def dashboard_summary(x: Inputs) -> DataFrame:
    return review.dashboard_summary(
        x.view("applications"), x.view("predictions"), x.view("feedback"),
        x.view("monitoring_snapshots"), x.view("retraining_tickets"),
    ).select(
        "applications", "scored", "decided", "pending", *rounded("risk_flag_rate"),
        *[f"{d}_count" for d in S.DECISIONS], *rounded("agreement_rate", "override_rate"),
        "latest_drift_status", "open_tickets")


@query("score_histogram", """
SELECT bin, CAST(bin AS DOUBLE) / 10 AS minimum, CAST(bin + 1 AS DOUBLE) / 10 AS maximum,
  count(*) AS count FROM (
  SELECT CASE WHEN score >= 1 THEN CAST(9 AS BIGINT) ELSE CAST(floor(score * 10) AS BIGINT) END AS bin
  FROM latest_prediction JOIN applications USING (application_id)) GROUP BY bin""")
def score_histogram(x: Inputs) -> DataFrame:
    return review.score_histogram(x.view("applications"), x.view("predictions"))


@query("review_bundle", """
SELECT a.application_id, a.external_reference, p.prediction_id, round(p.score, 6) AS score,
  f.feedback_id, CAST(f.version AS BIGINT) AS version, f.decision,
  CASE WHEN f.feedback_id IS NOT NULL
    THEN f.version = max(f.version) OVER (PARTITION BY f.prediction_id) END AS is_current
FROM applications a LEFT JOIN latest_prediction p USING (application_id)
LEFT JOIN feedback f ON f.prediction_id = p.prediction_id""")
def review_bundle(x: Inputs) -> DataFrame:
    return review.decision_history(
        x.view("applications"), x.view("predictions"), x.view("feedback")
    ).select("application_id", "external_reference", "prediction_id", *rounded("score"),
             "feedback_id", *longs("version"), "decision", "is_current")


@query("redact_audit", """
SELECT audit_id, CASE WHEN audit_id % 2 = 0 THEN 'action,reason' ELSE 'action' END AS kept_keys,
  CASE WHEN audit_id % 2 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS kept
FROM audit_events""")
def redact_audit(x: Inputs) -> DataFrame:
    last = F.when(F.col("audit_id") % 2 == 0, "reason").otherwise("Features")
    events = x.view("audit_events").select("audit_id", F.create_map(
        F.lit("action"), F.col("action"), F.lit("TOKEN"), F.lit("x"),
        F.lit("new_password"), F.lit("y"), last, F.col("action")).alias("metadata"))
    kept = F.map_keys(review.redact("metadata"))
    return events.select(
        "audit_id", F.array_join(F.sort_array(kept), ",").alias("kept_keys"),
        F.size(kept).cast("long").alias("kept"))


@query("ticket_gate", """
SELECT ticket_id, (SELECT snapshot_id FROM monitoring_snapshots WHERE status = 'drift_detected'
    ORDER BY created_at DESC, snapshot_id DESC LIMIT 1) AS monitoring_snapshot_id,
  CASE WHEN status <> 'open' THEN 'Retraining ticket has already been reviewed' END AS rejection,
  CASE WHEN status <> 'open' THEN status WHEN ticket_id % 2 = 0 THEN 'approved' ELSE 'rejected' END
    AS status
FROM retraining_tickets""")
def ticket_gate(x: Inputs) -> DataFrame:
    tickets = x.view("retraining_tickets")
    gated = review.gate_tickets(tickets, x.view("monitoring_snapshots")).filter(
        "rejection IS NULL").drop("rejection")
    reviews = tickets.select("ticket_id", (F.col("ticket_id") % 2 == 0).alias("approve"))
    return review.review_tickets(gated, reviews).select(
        "ticket_id", "monitoring_snapshot_id", "rejection", "status")


@query("decision_intake", f"""
WITH incoming AS (
  SELECT event_id AS request_id, event_id // 3 AS prediction_id, ts AS created_at,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 <> 1 END AS agreed,
    nullif(trim(CASE event_id % 5 WHEN 0 THEN ' checked ' WHEN 1 THEN '  ' END), '') AS note
  FROM events),
base AS (SELECT prediction_id, max(version) AS version FROM feedback GROUP BY prediction_id),
judged AS (
  SELECT i.*, b.version AS base_version, p.prediction_id IS NOT NULL AS known,
    count(*) FILTER (i.note IS NOT NULL OR i.agreed IS NULL OR i.agreed) OVER (
      PARTITION BY i.prediction_id ORDER BY i.created_at, i.request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM incoming i LEFT JOIN base b ON b.prediction_id = i.prediction_id
  LEFT JOIN predictions p ON p.prediction_id = i.prediction_id),
marked AS (SELECT *, CASE WHEN NOT known THEN '{rules.UNKNOWN_PREDICTION}'
    WHEN (base_version IS NOT NULL OR earlier > 0) AND note IS NULL THEN '{rules.AMEND_NEEDS_NOTE}'
    WHEN NOT agreed AND note IS NULL THEN '{rules.OVERRIDE_NEEDS_NOTE}' END AS rejection
  FROM judged)
SELECT request_id, prediction_id, rejection,
  CASE WHEN rejection IS NULL THEN CAST(coalesce(base_version, 0) + count(*) FILTER (rejection IS NULL)
    OVER (PARTITION BY prediction_id ORDER BY created_at, request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS version
FROM marked""")
def decision_intake(x: Inputs) -> DataFrame:
    kind = F.col("event_id") % 4
    incoming = x.table("events").select(
        F.col("event_id").alias("request_id"),
        F.floor(F.col("event_id") / 3).cast("long").alias("prediction_id"),
        F.lit("approve").alias("decision"),
        F.when(kind != 0, kind != 1).alias("agreed_with_model"),
        F.when(F.col("event_id") % 5 == 0, " checked ")
        .when(F.col("event_id") % 5 == 1, "  ").alias("note"),
        F.col("ts").alias("created_at"),
    )
    return rules.decision_intake(incoming, x.view("predictions"), x.view("feedback")).select(
        "request_id", "prediction_id", "rejection", *longs("version"))


@query("tickets_list", f"""
SELECT ticket_id, CAST(requested_by_id AS BIGINT) AS requested_by_id, status, {_AT}
FROM retraining_tickets t ORDER BY t.created_at DESC, ticket_id DESC LIMIT 100""")
def tickets_list(x: Inputs) -> DataFrame:
    return review.page(
        x.view("retraining_tickets"),
        [F.col("created_at").desc(), F.col("ticket_id").desc()], 100, highest=500,
    ).select("ticket_id", *longs("requested_by_id"), "status", text_time("created_at"))


@query("monitoring_history", f"""
SELECT snapshot_id, source, status, {_AT} FROM monitoring_snapshots m
ORDER BY m.created_at DESC, snapshot_id DESC LIMIT 300""")
def monitoring_history(x: Inputs) -> DataFrame:
    return drift.newest(
        x.view("monitoring_snapshots"), 300, ("created_at", "snapshot_id")
    ).select("snapshot_id", "source", "status", text_time("created_at"))


@query("replay_window", """
SELECT prediction_id, round(score, 6) AS score FROM predictions
ORDER BY created_at DESC, prediction_id DESC LIMIT 1000""")
def replay_window(x: Inputs) -> DataFrame:
    return adwin.replay_window(x.view("predictions")).select("prediction_id", *rounded("score"))


@query("json_fields", """
SELECT snapshot_id, CAST(json_extract_string(snapshot, '$.k') AS BIGINT) AS k
FROM monitoring_snapshots""")
def json_fields(x: Inputs) -> DataFrame:
    return x.view("monitoring_snapshots").select(
        "snapshot_id", F.get_json_object("snapshot", "$.k").cast("long").alias("k"))


@query("risk_flag", "SELECT prediction_id, score >= 0.5093 AS risk_flag FROM predictions")
def risk_flag(x: Inputs) -> DataFrame:
    return x.view("predictions").select(
        "prediction_id", derive.risk_flag("score", 0.5093).alias("risk_flag"))


@query("score_checks", """
SELECT score_check, count(*) AS scores FROM (
  SELECT CASE WHEN prediction_id % 11 = 0 THEN 'missing' WHEN prediction_id % 7 = 0 THEN 'not_finite'
    WHEN prediction_id % 5 = 0 THEN 'out_of_range' ELSE 'ok' END AS score_check
  FROM score_stream) GROUP BY score_check""")
def score_checks(x: Inputs) -> DataFrame:
    spoiled = x.view("score_stream").withColumn(
        "score",
        F.when(F.col("prediction_id") % 11 == 0, F.lit(None).cast("double"))
        .when(F.col("prediction_id") % 7 == 0, F.lit(float("nan")))
        .when(F.col("prediction_id") % 5 == 0, F.col("score") + 1.5)
        .otherwise(F.col("score")))
    return rules.score_checks(spoiled).groupBy("score_check").agg(
        F.count(F.lit(1)).alias("scores"))


def narrative_features(x: Inputs) -> DataFrame:
    """Loans with three hand-made contributions; no two of equal size per loan."""
    number = parse.parse_number
    entries = {
        "int_rate": (parse.parse_percent("int_rate") - 11.0) / F.lit(7.0),
        "dti": (number("dti") - 23.0) / F.lit(31.0),
        "open_acc": (F.lit(3.0) - number("open_acc")) / F.lit(5.0),
    }
    return x.loans().select("loan_id", F.array(*[
        F.struct(F.lit(n).alias("feature"), F.coalesce(v, F.lit(0.0)).alias("contribution"),
                 F.lit(None).cast("double").alias("feature_value"))
        for n, v in entries.items()
    ]).alias("attributions"))


@query("narratives", f"""
WITH entries AS (
  SELECT loan_id, 0 AS i, 'interest rate' AS shown,
    coalesce((({O.percent('int_rate')}) - 11.0) / 7.0, 0.0) AS c FROM loans_raw
  UNION ALL SELECT loan_id, 1, 'debt-to-income ratio',
    coalesce((({O.number('dti')}) - 23.0) / 31.0, 0.0) FROM loans_raw
  UNION ALL SELECT loan_id, 2, 'open acc',
    coalesce((3.0 - ({O.number('open_acc')})) / 5.0, 0.0) FROM loans_raw),
lists AS (SELECT loan_id,
  string_agg(shown, ', ' ORDER BY abs(c) DESC, i DESC) FILTER (c >= 0) AS raising,
  string_agg(shown, ', ' ORDER BY abs(c) DESC, i DESC) FILTER (c < 0) AS lowering
  FROM entries GROUP BY loan_id)
SELECT loan_id, CASE WHEN raising IS NOT NULL
    THEN 'Elevated risk is driven primarily by ' || raising || '.'
  ELSE 'The score is reduced primarily by ' || lowering || '.' END AS narrative FROM lists""")
def narratives(x: Inputs) -> DataFrame:
    return attributions.narrate(narrative_features(x)).select("loan_id", "narrative")


def snapshots_with_results(x: Inputs) -> DataFrame:
    """Snapshot records whose JSON lists one or two drifting features."""
    def entry(name):
        return F.struct(
            name.alias("feature"), F.lit(0.5).alias("statistic"), F.lit(0.001).alias("p_value"),
            F.lit(True).alias("drift_detected"), F.lit(10).alias("reference_count"),
            F.lit(12).alias("current_count"))

    first = F.concat(F.lit("feature_"), (
        F.get_json_object("snapshot", "$.k").cast("long") % 7).cast("string"))
    second = F.concat(F.lit("feature_"), (F.col("snapshot_id") % 11).cast("string"))
    results = F.when(
        F.col("snapshot_id") % 2 == 0, F.array(entry(first), entry(second))
    ).otherwise(F.array(entry(first)))
    return x.view("monitoring_snapshots").select(
        "snapshot_id", "created_at", F.to_json(F.struct(
            F.col("snapshot_id").alias("score_stream_count"), results.alias("feature_results"),
        )).alias("snapshot"))


@query("ks_trend_top", """
SELECT feature, count(*) AS snapshots FROM snapshot_entries GROUP BY feature
ORDER BY snapshots DESC, feature LIMIT 5""")
def ks_trend_top(x: Inputs) -> DataFrame:
    return drift.top_drifting_features(drift.read_snapshots(snapshots_with_results(x)))


@query("drift_status", """
SELECT user_id, CASE WHEN bool_or(value >= 400) OR count(*) FILTER (value >= 330
      AND event_type = 'error') > 0 THEN 'drift_detected'
    WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'stable' ELSE 'not_observed' END
  AS status FROM events GROUP BY user_id""")
def drift_status(x: Inputs) -> DataFrame:
    return x.table("events").groupBy("user_id").agg(
        F.bool_or(F.col("value") >= 400).alias("changed"),
        F.count_if((F.col("value") >= 330) & (F.col("event_type") == "error")).alias("features"),
        F.count_if(F.col("event_type") == "purchase").alias("scores"),
    ).select("user_id", drift.drift_status(
        F.col("changed"), F.col("features"), F.col("scores")).alias("status"))
