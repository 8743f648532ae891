"""Review-desk analytics over applications, predictions, decisions and audits.

"Latest per key" always goes through a group limit before the shuffle and lookups
are equi-joins, so one much-reviewed application or very active user never ends in
a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import derive
from ledgerlens.operators.ranking import latest_by

STATUSES = ("unscored", "scored", "decided", "escalated")


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest prediction per application."""
    return latest_by(
        predictions.filter(F.col("application_id").isNotNull()), ["application_id"],
        [F.col("created_at").desc(), F.col("prediction_id").desc()],
    )


def current_decisions(feedback: DataFrame) -> DataFrame:
    """Newest decision version per prediction."""
    return latest_by(
        feedback, ["prediction_id"], [F.col("version").desc(), F.col("created_at").desc()]
    )


def dedupe_latest(feedback: DataFrame) -> DataFrame:
    """One row per prediction: highest version, then newest, then highest id."""
    return latest_by(
        feedback, ["prediction_id"],
        [F.col("version").desc(), F.col("created_at").desc(), F.col("feedback_id").desc()],
    )


def latest_scored(applications: DataFrame, predictions: DataFrame) -> DataFrame:
    latest = latest_predictions(predictions).select(
        "application_id", "prediction_id", "score", "risk_flag"
    )
    return latest.join(applications.select("application_id", "created_by_id"), "application_id")


def application_status(
    applications: DataFrame, predictions: DataFrame, feedback: DataFrame
) -> DataFrame:
    """Applications with latest prediction, its current decision and a status."""
    latest = latest_predictions(predictions).select(
        "application_id", F.col("prediction_id").alias("latest_prediction_id"),
        "score", "risk_flag",
    )
    decisions = current_decisions(feedback.select(
        "prediction_id", "version", "created_at", "decision")).select(
        F.col("prediction_id").alias("latest_prediction_id"),
        F.col("decision").alias("current_decision"),
    )
    status = (
        F.when(F.col("current_decision") == "escalate", "escalated")
        .when(F.col("current_decision").isNotNull(), "decided")
        .when(F.col("latest_prediction_id").isNotNull(), "scored")
        .otherwise("unscored")
    )
    return (
        applications.join(latest, "application_id", "left")
        .join(decisions, "latest_prediction_id", "left")
        .withColumn("status", status)
        .select(*applications.columns, "latest_prediction_id", "score", "risk_flag",
                "current_decision", "status")
    )


def contains_text(search: str, *columns: Column | str) -> Column:
    """Case-insensitive containment in any column; wildcards in the search work."""
    pattern = f"%{search.strip()}%"
    test = F.lit(False)
    for column in columns:
        value = F.col(column) if isinstance(column, str) else column
        test = test | F.coalesce(value.cast("string").ilike(pattern), F.lit(False))
    return test


def between_dates(
    column: str, date_from: datetime | str | None, date_to: datetime | str | None
) -> Column:
    """Both ends inclusive, each optional."""
    test = F.lit(True)
    if date_from is not None:
        test = test & (F.col(column) >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        test = test & (F.col(column) <= F.lit(date_to).cast("timestamp"))
    return test


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0,
         highest: int = 200) -> DataFrame:
    """One page in a total order; limit clamped to [1, ``highest``], offset to >= 0."""
    ordered = df.orderBy(*order)
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(min(max(limit, 1), highest))


def with_total(listing: DataFrame, paged: DataFrame) -> DataFrame:
    """Attach the unpaged row count: one number, counted before the page is cut."""
    return paged.withColumn("total", F.lit(listing.count()).cast("long"))


def filter_applications(
    statuses: DataFrame, *, search: str | None = None, status: str | None = None,
    risk_flag: bool | None = None, date_from=None, date_to=None,
) -> DataFrame:
    test = between_dates("created_at", date_from, date_to)
    if search:
        test = test & contains_text(search, "external_reference", "application_id")
    if status is not None:
        if status not in STATUSES:
            raise DataContractError(f"status must be one of {STATUSES}")
        test = test & (F.col("status") == status)
    if risk_flag is not None:
        test = test & (F.col("risk_flag") == F.lit(risk_flag))
    return statuses.filter(test)


def filter_predictions(
    predictions: DataFrame, feedback: DataFrame, *, risk_flag: bool | None = None,
    application_id=None, decision_status: str | None = None, date_from=None, date_to=None,
) -> DataFrame:
    test = between_dates("created_at", date_from, date_to)
    if risk_flag is not None:
        test = test & (F.col("risk_flag") == F.lit(risk_flag))
    if application_id is not None:
        test = test & (F.col("application_id") == F.lit(application_id))
    listed = predictions.filter(test)
    if not decision_status:
        return listed
    wanted = decision_status.strip().lower()
    if wanted not in ("pending", "decided", *S.DECISIONS):
        raise DataContractError("decision_status must be pending, decided or a decision")
    if wanted == "pending":  # no decision at all: an anti join, no versions needed
        return listed.join(decided_ids(feedback), "prediction_id", "left_anti")
    if wanted == "decided":
        return listed.join(decided_ids(feedback), "prediction_id", "left_semi")
    current = current_decisions(
        feedback.select("prediction_id", "version", "created_at", "decision")
    ).filter(F.col("decision") == wanted)
    return listed.join(current.select("prediction_id"), "prediction_id", "left_semi")


def decided_ids(feedback: DataFrame) -> DataFrame:
    """Predictions with a decision; distinct first, so copies shrink before a join."""
    return feedback.select("prediction_id").distinct()


def mark_current(feedback: DataFrame) -> DataFrame:
    """``is_current``: no higher version exists. A map-side combined maximum joined
    back; adaptive execution splits a hot prediction in that join."""
    highest = feedback.groupBy("prediction_id").agg(F.max("version").alias("_highest"))
    return feedback.join(highest, "prediction_id").withColumn(
        "is_current", F.col("version") == F.col("_highest")
    ).drop("_highest")


def filter_feedback(
    feedback: DataFrame, *, prediction_id=None, decision: str | None = None,
    date_from=None, date_to=None,
) -> DataFrame:
    test = between_dates("created_at", date_from, date_to)
    if prediction_id is not None:
        test = test & (F.col("prediction_id") == F.lit(prediction_id))
    if decision is not None:
        if decision not in S.DECISIONS:
            raise DataContractError(f"decision must be one of {S.DECISIONS}")
        test = test & (F.col("decision") == decision)
    return mark_current(feedback).filter(test)


def filter_audit(
    events: DataFrame, users: DataFrame, *, action: str | None = None,
    entity_type: str | None = None, actor_user_id=None, actor: str | None = None,
    date_from=None, date_to=None,
) -> DataFrame:
    """Audit events with the actor's name where known."""
    test = between_dates("created_at", date_from, date_to)
    if action:
        test = test & (F.col("action") == action)
    if entity_type:
        test = test & (F.col("entity_type") == entity_type)
    if actor_user_id is not None:
        test = test & (F.col("actor_user_id") == F.lit(actor_user_id))
    names = users.select(F.col("user_id").alias("actor_user_id"),
                         F.col("username").alias("actor_username"))
    joined = events.filter(test).join(names, "actor_user_id", "left")
    if actor:
        joined = joined.filter(
            contains_text(actor, "actor_username")
            | F.coalesce(F.col("actor_user_id").cast("string") == actor.strip(), F.lit(False))
        )
    return joined


def filter_users(
    users: DataFrame, *, search: str | None = None, role: str | None = None,
    active: bool | None = None,
) -> DataFrame:
    test = F.lit(True)
    if search:
        searchable = [c for c in ("username", "full_name", "email") if c in users.columns]
        test = test & contains_text(search, *searchable)
    if role is not None:
        test = test & (F.col("role") == role)
    if active is not None:
        test = test & (F.col("is_active") == F.lit(active))
    return users.filter(test)


def role_permission_table(spark: SparkSession) -> DataFrame:
    """(role, permission): the fixed catalogue, a few dozen rows."""
    pairs = [(role, code) for role, codes in S.ROLE_PERMISSIONS.items() for code in codes]
    return spark.createDataFrame(pairs, "role string, permission string")


def role_permissions(users: DataFrame) -> DataFrame:
    """Per user: role and sorted permission codes. The catalogue is broadcast."""
    catalogue = role_permission_table(users.sparkSession).groupBy("role").agg(
        F.array_join(F.sort_array(F.collect_list("permission")), ",").alias("permissions"),
        F.count(F.lit(1)).alias("permission_count"),
    )
    return users.join(F.broadcast(catalogue), "role", "left")


def visible_to(
    records: DataFrame, *, user_id, role: str, owner: str, read_all: str
) -> DataFrame:
    """Rows one user may read: all with the permission, else the user's own."""
    if read_all in S.ROLE_PERMISSIONS.get(role, ()):
        return records
    return records.filter(F.col(owner) == F.lit(user_id))


def access_counts(
    records: DataFrame, users: DataFrame, *, owner: str, read_all: str
) -> DataFrame:
    """Per user: whether all records are visible, and how many records are."""
    spark = records.sparkSession
    everyone = role_permission_table(spark).filter(F.col("permission") == read_all).select(
        "role", F.lit(True).alias("reads_all")
    )
    per_owner = records.groupBy(F.col(owner).alias("user_id")).agg(F.count(F.lit(1)).alias("own"))
    total = F.lit(records.count()).cast("long")
    return (
        users.join(F.broadcast(everyone), "role", "left")
        .join(per_owner, "user_id", "left")
        .select(
            "user_id", "role",
            F.coalesce("reads_all", F.lit(False)).alias("reads_all"),
            F.when(F.col("reads_all"), total)
            .otherwise(F.coalesce("own", F.lit(0))).alias("visible_records"),
        )
    )


def decision_history(
    applications: DataFrame, predictions: DataFrame, feedback: DataFrame
) -> DataFrame:
    """Review bundles as rows: each application with its latest prediction, and one
    row per decision on it (version order, current one marked). Applications
    without prediction or decision keep one row with nulls.

    An outer join could not split a prediction that holds very many decisions, so
    decided applications come from an inner join and the others from an anti join.
    """
    latest = latest_predictions(predictions).select(
        "application_id", "prediction_id", "score", "risk_flag"
    )
    history = mark_current(feedback.select(
        "prediction_id", "feedback_id", "version", "decision", "agreed_with_model"))
    scored = applications.select("application_id", "external_reference").join(
        latest, "application_id", "left"
    )
    undecided = scored.join(decided_ids(feedback), "prediction_id", "left_anti")
    return history.join(scored, "prediction_id").unionByName(undecided, allowMissingColumns=True)


def review_bundle(
    application_id, applications: DataFrame, predictions: DataFrame, feedback: DataFrame
) -> DataFrame:
    """Decision history of one application, oldest version first."""
    one = F.col("application_id") == F.lit(application_id)
    return decision_history(
        applications.filter(one), predictions.filter(one), feedback
    ).orderBy("version")


def decided_rows(latest: DataFrame, feedback: DataFrame) -> DataFrame:
    """Current decisions on the given latest predictions."""
    current = current_decisions(feedback.select(
        "prediction_id", "version", "created_at", "decision", "agreed_with_model"))
    return current.join(latest.select("prediction_id"), "prediction_id", "left_semi")


def dashboard_summary(
    applications: DataFrame, predictions: DataFrame, feedback: DataFrame,
    snapshots: DataFrame, tickets: DataFrame, *, owner_id=None,
) -> DataFrame:
    """One row of portfolio figures. Drift status and open tickets ignore the owner.

    Every part is a single aggregate row; their union folds into one row.
    """
    owned = applications if owner_id is None else applications.filter(
        F.col("created_by_id") == F.lit(owner_id)
    )
    scored = latest_scored(owned, predictions)
    decisions = decided_rows(scored, feedback)
    rated = F.count("agreed_with_model")
    agreed = F.count_if(F.col("agreed_with_model"))
    parts = [
        owned.agg(F.count(F.lit(1)).alias("applications")),
        scored.agg(
            F.count(F.lit(1)).alias("scored"),
            F.avg(F.when(F.col("risk_flag"), 1.0).otherwise(0.0)).alias("risk_flag_rate"),
        ),
        decisions.agg(
            F.count(F.lit(1)).alias("decided"),
            *[F.count_if(F.col("decision") == d).alias(f"{d}_count") for d in S.DECISIONS],
            F.try_divide(agreed, rated).alias("agreement_rate"),
            F.try_divide(rated - agreed, rated).alias("override_rate"),
        ),
        snapshots.agg(
            F.coalesce(
                F.max_by("status", F.struct("created_at", "snapshot_id")),
                F.lit("not_observed"),
            ).alias("latest_drift_status")
        ),
        tickets.agg(F.count_if(F.col("status") == "open").alias("open_tickets")),
    ]
    return fold_rows(parts).withColumn(
        "pending", F.greatest(F.col("scored") - F.col("decided"), F.lit(0))
    )


def fold_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Single-row frames with different columns side by side, without a join."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.agg(*[F.first(c, ignorenulls=True).alias(c) for c in whole.columns])


def score_histogram(applications: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ten score bins over latest predictions; a score of one joins the last bin."""
    return (
        latest_scored(applications, predictions)
        .groupBy(derive.score_bin("score").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (F.col("bin") / 10).alias("minimum"),
                ((F.col("bin") + 1) / 10).alias("maximum"), "count")
    )


def recent_applications(statuses: DataFrame, limit: int = 5) -> DataFrame:
    return statuses.orderBy(
        F.col("created_at").desc(), F.col("application_id").desc()
    ).limit(limit)


def exposures(predictions: DataFrame) -> DataFrame:
    """One exposure per prediction, in the arm of the officer who requested it."""
    return predictions.select(
        "prediction_id", F.col("requested_by_id").alias("officer_id"),
        derive.study_arm("requested_by_id").alias("variant"),
    )


def experiment_arms(exposed: DataFrame, feedback: DataFrame) -> DataFrame:
    """Exposures, decisions and rates per arm; both arms always present.

    A left join keeps undecided exposures, so one grouped aggregate gives exposure
    and decision counts (a prediction may be exposed more than once)."""
    current = current_decisions(feedback.select(
        "prediction_id", "version", "created_at", "feedback_id", "agreed_with_model"))
    arms = exposed.sparkSession.createDataFrame(
        [(S.ARM_SHOWN,), (S.ARM_SCORE_ONLY,)], "variant string"
    )
    counted = exposed.join(current, "prediction_id", "left").groupBy("variant").agg(
        F.count(F.lit(1)).alias("exposures"),
        F.count("feedback_id").alias("decisions"),
        F.count_if(F.col("agreed_with_model")).alias("agreed"),
        F.count("agreed_with_model").alias("rated"),
    )
    return counted.join(F.broadcast(arms), "variant", "right").select(
        "variant",
        F.coalesce("exposures", F.lit(0)).alias("exposures"),
        F.coalesce("decisions", F.lit(0)).alias("decisions"),
        F.try_divide("agreed", "rated").alias("agreement_rate"),
        F.try_divide(F.col("rated") - F.col("agreed"), "rated").alias("override_rate"),
    )


def redact(metadata: Column | str) -> Column:
    """Drop sensitive keys from a metadata map, whatever their case."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.map_filter(column, lambda k, _: ~F.lower(k).isin(*S.SENSITIVE_KEYS))


def gate_tickets(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Ticket requests need a persisted drift alert; the latest one is linked."""
    alert = snapshots.filter(F.col("status") == "drift_detected").agg(
        F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("latest")
    ).first()["latest"]
    kind = snapshots.schema["snapshot_id"].dataType
    return requests.withColumn("monitoring_snapshot_id", F.lit(alert).cast(kind)).withColumn(
        "rejection",
        F.when(F.col("monitoring_snapshot_id").isNull(),
               "A persisted drift-detected monitoring snapshot is required"),
    )


def review_tickets(tickets: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply reviews (ticket_id, approve) to open tickets; others are rejected."""
    joined = tickets.join(reviews, "ticket_id")
    is_open = F.col("status") == "open"
    return joined.withColumn(
        "rejection", F.when(~is_open, "Retraining ticket has already been reviewed")
    ).withColumn(
        "status",
        F.when(is_open, F.when(F.col("approve"), "approved").otherwise("rejected"))
        .otherwise(F.col("status")),
    )
