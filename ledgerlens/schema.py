"""Column names, domains and texts that results depend on.

Everything here is a fixed value of the data contract: it must not change for
results to stay comparable between releases.
"""

from __future__ import annotations

SCHEMA_VERSION = "1.0.0"
LAYOUT_VERSION = 1

LOAN_ID = "loan_id"
STATUS = "loan_status"
TARGET = "target"
ISSUE_DATE = "issue_d"
EARLIEST_CREDIT = "earliest_cr_line"
QUARTER = "issue_quarter"
SPLIT = "dataset_split"
SPLITS = ("train", "validation", "shift")
VIEWS = ("unscaled", "scaled")

# Raw predictors in contract order.
MONEY_AND_COUNTS = (
    "annual_inc", "dti", "revol_bal", "open_acc", "total_acc", "delinq_2yrs",
    "inq_last_6mths", "loan_amnt", "installment",
)
PERCENTS = ("revol_util", "int_rate")
RAW_NUMERIC = (
    "annual_inc", "dti", "revol_util", "revol_bal", "open_acc", "total_acc",
    "delinq_2yrs", "inq_last_6mths", "loan_amnt", "term", "int_rate",
    "installment", "emp_length",
)
DERIVED_NUMERIC = ("loan_to_income", "installment_to_income", "credit_history_years")
NUMERIC = RAW_NUMERIC + DERIVED_NUMERIC
ORDINALS = ("grade", "sub_grade")
CATEGORIES = ("purpose", "home_ownership")
PREDICTORS = (
    "annual_inc", "dti", "revol_util", "revol_bal", "open_acc", "total_acc",
    "delinq_2yrs", "inq_last_6mths", "loan_amnt", "term", "int_rate",
    "installment", "grade", "sub_grade", "purpose", "emp_length",
    "home_ownership", EARLIEST_CREDIT, ISSUE_DATE,
)
ALLOWED = PREDICTORS + (STATUS,)

# Fields known only after origination.
POST_ORIGINATION = (
    "collection_recovery_fee",
    "debt_settlement_flag",
    "debt_settlement_flag_date",
    "deferral_term",
    "hardship_amount",
    "hardship_dpd",
    "hardship_end_date",
    "hardship_flag",
    "hardship_last_payment_amount",
    "hardship_length",
    "hardship_loan_status",
    "hardship_payoff_balance_amount",
    "hardship_reason",
    "hardship_start_date",
    "hardship_status",
    "hardship_type",
    "last_credit_pull_d",
    "last_fico_range_high",
    "last_fico_range_low",
    "last_pymnt_amnt",
    "last_pymnt_d",
    "next_pymnt_d",
    "orig_projected_additional_accrued_interest",
    "out_prncp",
    "out_prncp_inv",
    "payment_plan_start_date",
    "pymnt_plan",
    "recoveries",
    "settlement_amount",
    "settlement_date",
    "settlement_percentage",
    "settlement_status",
    "settlement_term",
    "total_pymnt",
    "total_pymnt_inv",
    "total_rec_int",
    "total_rec_late_fee",
    "total_rec_prncp",
)

# Outcome vocabulary after trimming and lower-casing.
DEFAULTED = ("charged off", "default")
REPAID = ("fully paid",)

# Tokens read as null from files, and texts read as missing later.
FILE_NULLS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
MISSING_TEXT = ("", "na", "n/a", "none", "null", "nan", "nat")

GRADES = "ABCDEFG"
SUB_GRADE_STEPS = 5
UNKNOWN_ORDINAL = -1
MISSING_CATEGORY = "__MISSING__"
MISSING_FLAG_SUFFIX = "_was_missing"
DAYS_PER_YEAR = 365.25

# Serving domains.
PURPOSES = (
    "car", "credit_card", "debt_consolidation", "educational", "home_improvement",
    "house", "major_purchase", "medical", "moving", "other", "renewable_energy",
    "small_business", "vacation", "wedding",
)
HOME_OWNERSHIP = ("ANY", "MORTGAGE", "NONE", "OTHER", "OWN", "RENT")

# Roles and their permission codes.
CREATE_PERMISSIONS = ("application:create", "prediction:create", "feedback:create")
ROLE_PERMISSIONS = {
    "loan_officer": CREATE_PERMISSIONS + (
        "application:read_own", "prediction:read_own", "feedback:read_own",
        "experiment:participate", "dashboard:read",
    ),
    "risk_analyst": CREATE_PERMISSIONS + (
        "application:read_all", "prediction:read_all", "feedback:read_all",
        "monitoring:read", "monitoring:run_check", "retraining:create",
        "retraining:read", "model:read", "experiment:read_results", "dashboard:read",
    ),
    "admin": CREATE_PERMISSIONS + (
        "application:read_all", "prediction:read_all", "feedback:read_all",
        "monitoring:read", "monitoring:run_check", "retraining:create",
        "retraining:read", "retraining:review", "model:read",
        "experiment:read_results", "dashboard:read", "user:manage", "role:read",
        "audit:read",
    ),
}
SENSITIVE_KEYS = (
    "password", "current_password", "new_password", "temporary_password", "token", "features",
)
ARM_SHOWN, ARM_SCORE_ONLY = "explanation_shown", "score_only"
WITHHELD_NARRATIVE = "Explanation withheld for the score-only study condition."
DECISIONS = ("approve", "decline", "escalate")

# Reader-facing feature names.
DISPLAY_NAMES = {
    "annual_inc": "annual income",
    "dti": "debt-to-income ratio",
    "int_rate": "interest rate",
    "loan_amnt": "loan amount",
    "loan_to_income": "loan-to-income ratio",
    "installment_to_income": "installment-to-income ratio",
    "credit_history_years": "credit history length",
    "revol_util": "revolving credit utilization",
    "revol_bal": "revolving balance",
    "emp_length": "employment length",
    "grade": "loan grade",
    "sub_grade": "loan sub-grade",
}


def missing_flag(feature: str) -> str:
    return feature + MISSING_FLAG_SUFFIX
