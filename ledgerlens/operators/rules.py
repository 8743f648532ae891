"""Row rules as arrays of (field, message), and batch decision intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import parse
from ledgerlens.operators.ranking import latest_by, numbered

#: When a rule is broken, the field it names, and its message.
Rule = tuple[Column, str, str]

# Fixed values: (lowest, highest) accepted number per field.
RANGES = {
    "annual_inc": (0, 1_000_000_000),
    "dti": (0, 1_000),
    "revol_bal": (0, 1_000_000_000),
    "open_acc": (0, 10_000),
    "total_acc": (0, 10_000),
    "delinq_2yrs": (0, 10_000),
    "inq_last_6mths": (0, 10_000),
    "loan_amnt": (0, 10_000_000),
    "installment": (0, 10_000_000),
}
# Accepted texts after trimming and lower-casing.
TERMS = ("36", "36.0", "36 month", "36 months", "60", "60.0", "60 month", "60 months")
NO_EMPLOYMENT = ("", "n/a", "na", "none", "null")
UNDER_ONE_YEAR = ("< 1 year", "<1 year", "less than 1 year")
PERCENT_SHAPE = r"^-?\d+(\.\d+)?%?$"
# Messages.
MESSAGES = {
    "number": "must be a number in range",
    "term": "term must be 36, 60, '36 months', or '60 months'",
    "emp_length_text": "emp_length must be a number of years",
    "emp_length_range": "emp_length must be between 0 and 100 years",
    "int_rate_text": "int_rate must be a number or percentage",
    "int_rate_range": "int_rate must be between 0 and 1000",
    "int_rate": "int_rate must be between 0 and 100",
    "revol_util_text": "revol_util must be a number or percentage",
    "revol_util_range": "revol_util must be between 0 and 1000",
    "grade": "grade must be A through G",
    "sub_grade": "sub_grade must be A1 through G5",
    "purpose": "purpose is not allowed",
    "home_ownership": "home_ownership is not allowed",
    "issue_d": "issue_d must be a supported date",
    "earliest_cr_line": "earliest_cr_line must be a supported date",
    "date_order": "earliest_cr_line must not be after issue_d",
    "grade_order": "sub_grade must belong to grade",
}
# Warnings, and messages of decision intake.
WARNINGS = {
    "dti": "Debt-to-income ratio is above 100%; verify that the value is intentional.",
    "int_rate":
        "Interest rate is normally entered as a number or a percentage, for example 11.2%.",
    "revol_util":
        "Revolving utilization is normally entered as a number or a percentage, for example 38%.",
}
AMEND_NEEDS_NOTE = "A note is required when amending a prior decision"
OVERRIDE_NEEDS_NOTE = "A note is required when overriding the model"
UNKNOWN_PREDICTION = "Prediction not found"


def _note(rule: Rule) -> Column:
    broken, field, message = rule
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def _outside(number: Column, low: float, high: float) -> Column:
    return number.isNull() | (number < low) | (number > high)


def _rule_inputs(df: DataFrame) -> DataFrame:
    """Cleaned texts, then numbers and dates, under ``_t_`` and ``_n_`` names."""
    texts = df.select(
        *df.columns,
        *[parse.strip(c).alias(f"_t_{c}") for c in (*RANGES, "revol_util", "int_rate")],
        F.lower(parse.strip("term")).alias("_t_term"),
        F.lower(parse.strip("emp_length")).alias("_t_emp_length"),
        F.upper(parse.strip("grade")).alias("_t_grade"),
        F.upper(parse.strip("sub_grade")).alias("_t_sub_grade"),
        F.replace(F.lower(parse.strip("purpose")), F.lit(" "), F.lit("_")).alias("_t_purpose"),
        F.replace(F.upper(parse.strip("home_ownership")), F.lit(" "), F.lit("_"))
        .alias("_t_home_ownership"),
        F.lower(parse.strip(S.EARLIEST_CREDIT)).alias("_t_earliest"),
        parse.present(S.ISSUE_DATE).alias("_p_issued"),
        parse.present(S.EARLIEST_CREDIT).alias("_p_earliest"),
    )
    percent = {
        c: parse.strip(F.regexp_replace(f"_t_{c}", r"%$", "")) for c in ("revol_util", "int_rate")
    }
    years = F.regexp_replace(F.replace("_t_emp_length", F.lit("+"), F.lit("")), r" years?$", "")
    return texts.select(
        *texts.columns,
        *[parse.plain_number(F.col(f"_t_{c}")).alias(f"_n_{c}") for c in RANGES],
        *[parse.plain_number(text).alias(f"_n_{c}") for c, text in percent.items()],
        parse.plain_number(parse.strip(years)).alias("_n_emp_length"),
        # Serving dates have day precision.
        parse.date_from("_p_issued").cast("date").alias("_d_issued"),
        parse.date_from("_p_earliest").cast("date").alias("_d_earliest"),
    )


def _rules() -> list[Rule]:
    """All rules, in their order."""
    rules: list[Rule] = []
    for name, (low, high) in RANGES.items():
        number = F.col(f"_n_{name}")
        broken = F.col(f"_t_{name}").isNotNull() & _outside(number, low, high)
        if name == "loan_amnt":  # an amount of zero is no loan
            broken = broken | F.coalesce(number == 0, F.lit(False))
        rules.append((broken, name, MESSAGES["number"]))

    for name in ("revol_util", "int_rate"):
        number = F.col(f"_n_{name}")
        unread = F.col(f"_t_{name}").isNotNull() & number.isNull()
        rules.append((unread, name, MESSAGES[f"{name}_text"]))
        rules.append(((number < 0) | (number > 1_000), name, MESSAGES[f"{name}_range"]))
    # Rates over 1000 have broken the rule before.
    rate = F.col("_n_int_rate")
    rules.append(((rate > 100) & (rate <= 1_000), "int_rate", MESSAGES["int_rate"]))

    rules.append((~F.col("_t_term").isin(*TERMS), "term", MESSAGES["term"]))

    text, years = F.col("_t_emp_length"), F.col("_n_emp_length")
    stated = text.isNotNull() & ~text.isin(*NO_EMPLOYMENT, *UNDER_ONE_YEAR)
    rules.append((stated & years.isNull(), "emp_length", MESSAGES["emp_length_text"]))
    rules.append((
        stated & years.isNotNull() & _outside(years, 0, 100),
        "emp_length", MESSAGES["emp_length_range"]))

    grade, sub_grade = F.col("_t_grade"), F.col("_t_sub_grade")
    rules.append((~grade.rlike(f"^[{S.GRADES}]$"), "grade", MESSAGES["grade"]))
    rules.append((
        ~sub_grade.rlike(f"^[{S.GRADES}][1-5]$"), "sub_grade", MESSAGES["sub_grade"]))
    rules.append((
        ~F.col("_t_purpose").isin(*S.PURPOSES), "purpose", MESSAGES["purpose"]))
    rules.append((
        ~F.col("_t_home_ownership").isin(*S.HOME_OWNERSHIP),
        "home_ownership", MESSAGES["home_ownership"]))

    issued, earliest = F.col("_d_issued"), F.col("_d_earliest")
    rules.append((issued.isNull(), "issue_d", MESSAGES["issue_d"]))
    rules.append((
        ~F.col("_t_earliest").isin(*NO_EMPLOYMENT) & earliest.isNull(),
        "earliest_cr_line", MESSAGES["earliest_cr_line"]))
    rules.append((earliest > issued, "earliest_cr_line", MESSAGES["date_order"]))
    rules.append((
        (F.length(grade) > 0) & (F.length(sub_grade) > 0)
        & (grade != F.substring(sub_grade, 1, 1)),
        "sub_grade", MESSAGES["grade_order"]))
    return rules


def _warnings() -> Column:
    warnings = [F.when(F.col("_n_dti") > 100, F.struct(
        F.lit("dti").alias("field"), F.lit(WARNINGS["dti"]).alias("message")))]
    for name in ("int_rate", "revol_util"):
        text = F.col(f"_t_{name}")
        odd = (F.length(text) > 0) & ~text.rlike(PERCENT_SHAPE)
        warnings.append(F.when(odd, F.struct(
            F.lit(name).alias("field"), F.lit(WARNINGS[name]).alias("message"))))
    return F.array_compact(F.array(*warnings))


def check_applications(df: DataFrame) -> DataFrame:
    """Add ``violations``, in rule order, and ``warnings``: unusual but accepted."""
    return _rule_inputs(df).select(
        *df.columns, F.array_compact(F.array(*map(_note, _rules()))).alias("violations"), _warnings().alias("warnings")
    )


def soft_warnings(df: DataFrame) -> DataFrame:
    """Only the warnings; needs ``dti``, ``int_rate`` and ``revol_util``."""
    texts = df.select(
        *df.columns, parse.plain_number(parse.strip("dti")).alias("_n_dti"),
        *[parse.strip(c).alias(f"_t_{c}") for c in ("int_rate", "revol_util")],
    )
    return texts.select(*df.columns, _warnings().alias("warnings"))


def violation_counts(df: DataFrame) -> DataFrame:
    """Broken rows per rule. One counter a rule over inputs cleaned once: the rules never
    become arrays, whose explosion would have the optimiser copy every rule into a filter."""
    rules = _rules()
    counts = _rule_inputs(df).agg(
        *[F.count_if(broken).alias(f"_{k}") for k, (broken, _, _) in enumerate(rules)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"),
                 F.col(f"_{k}").alias("violations"))
        for k, (_, field, message) in enumerate(rules)]))).filter("violations > 0")


def warning_counts(df: DataFrame) -> DataFrame:
    return (
        soft_warnings(df).select(F.explode("warnings").alias("w"))
        .groupBy(F.col("w.field").alias("field"))
        .agg(F.count(F.lit(1)).alias("warnings"))
    )


def score_checks(df: DataFrame, score: str = "score") -> DataFrame:
    """Label each score: ``ok``, ``missing``, ``not_finite`` or ``out_of_range``."""
    value = F.col(score)
    return df.withColumn(
        "score_check",
        F.when(value.isNull(), "missing")
        .when(parse.finite_or_null(value).isNull(), "not_finite")
        .when((value < 0) | (value > 1), "out_of_range")
        .otherwise("ok"),
    )


def clean_note(note: str = "note") -> Column:
    """Trimmed note; blank is no note."""
    return F.nullif(parse.strip(note), F.lit(""))


def _rejection(has_previous: Column, agreed: Column, note: Column) -> Column:
    return (
        F.when(has_previous & note.isNull(), AMEND_NEEDS_NOTE)
        .when((agreed == F.lit(False)) & note.isNull(), OVERRIDE_NEEDS_NOTE)
    )


def decision_intake(
    incoming: DataFrame, predictions: DataFrame, feedback: DataFrame
) -> DataFrame:
    """Check a batch of decisions and allocate versions.

    ``incoming``: request_id, prediction_id, decision, agreed_with_model, note,
    created_at. Requests are taken per prediction in (created_at, request_id)
    order, as if they arrived one by one: an accepted request becomes the previous
    decision of the next. Adds ``rejection`` (null when accepted), ``version`` and
    ``amends_feedback_id`` (an existing feedback or an earlier request of the batch).

    Acceptance needs no sequential pass. A request that carries a note is always
    accepted. One without is accepted only while no decision exists, that is for
    predictions without feedback and before the first accepted request of the
    batch; so the first acceptable request per prediction settles all others.
    """
    latest = latest_by(
        feedback.select("prediction_id", "version", "created_at", "feedback_id"),
        ["prediction_id"],
        [F.col("version").desc(), F.col("created_at").desc()],
    ).select("prediction_id", F.col("version").alias("base_version"),
             F.col("feedback_id").alias("base_feedback_id"))
    known = predictions.select("prediction_id").withColumn("known", F.lit(True))

    note = F.col("note")
    first_ok = note.isNotNull() | F.coalesce(F.col("agreed_with_model"), F.lit(True))
    requests = incoming.withColumn("note", clean_note())
    first = requests.filter(first_ok).groupBy("prediction_id").agg(
        F.min(F.struct("created_at", "request_id")).alias("first_acceptable")
    )
    joined = (
        requests.join(known, "prediction_id", "left")
        .join(latest, "prediction_id", "left")
        .join(first, "prediction_id", "left")
    )
    here = F.struct("created_at", "request_id")
    has_previous = F.col("base_version").isNotNull() | F.coalesce(
        F.col("first_acceptable") < here, F.lit(False)
    )
    judged = joined.withColumn(
        "rejection",
        F.when(F.col("known").isNull(), UNKNOWN_PREDICTION).otherwise(
            _rejection(has_previous, F.col("agreed_with_model"), note)
        ),
    )
    accepted = numbered(
        judged.filter("rejection IS NULL").select(
            "request_id", "prediction_id", "created_at", "base_version", "base_feedback_id"),
        ["prediction_id"], ["created_at", "request_id"], "step",
    )
    previous = accepted.select(
        "prediction_id", (F.col("step") + 1).alias("step"),
        F.col("request_id").alias("previous_request_id"),
    )
    versioned = accepted.join(previous, ["prediction_id", "step"], "left").select(
        "request_id",
        (F.coalesce("base_version", F.lit(0)) + F.col("step")).cast("int").alias("version"),
        F.when(F.col("previous_request_id").isNull(), F.col("base_feedback_id"))
        .alias("amends_feedback_id"),
        F.col("previous_request_id").alias("amends_request_id"),
    )
    return judged.join(versioned, "request_id", "left").select(
        "request_id", "prediction_id", "decision", "agreed_with_model", "note", "created_at",
        "rejection", "version", "amends_feedback_id", "amends_request_id",
    )


def amendment_chain(feedback: DataFrame) -> DataFrame:
    """Stored decisions with the id each one amends: the previous version, found
    by an equi-join so that one much-amended prediction needs no single task."""
    previous = feedback.select(
        "prediction_id", (F.col("version") + 1).alias("version"),
        F.col("feedback_id").alias("amends_feedback_id"),
    )
    return feedback.join(previous, ["prediction_id", "version"], "left")
