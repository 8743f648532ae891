"""SQL building blocks that state query results independently of the library."""

from __future__ import annotations

import re

from ledgerlens import schema as S
from ledgerlens.plans import binding

MISSING = "('', 'na', 'n/a', 'none', 'null', 'nan', 'nat')"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def missing(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN {MISSING})"


def number(c: str) -> str:
    text = f"trim(replace(replace({c}, ',', ''), '$', ''))"
    return (f"CASE WHEN NOT {missing(c)} AND regexp_matches({text}, '{NUMBER}') "
            f"THEN CAST({text} AS DOUBLE) END")


def percent(c: str) -> str:
    text = f"trim(rtrim(trim(replace(replace({c}, ',', ''), '$', '')), '%'))"
    return (f"CASE WHEN NOT {missing(c)} AND regexp_matches({text}, '{NUMBER}') "
            f"THEN CAST({text} AS DOUBLE) END")


def term(c: str) -> str:
    part = f"regexp_extract(trim({c}), '^([0-9]+(?:\\.0+)?)\\s*(?:months?)?$', 1)"
    return f"CASE WHEN NOT {missing(c)} AND {part} <> '' THEN CAST({part} AS DOUBLE) END"


def emp_length(c: str) -> str:
    text = f"regexp_replace(lower(trim({c})), '\\s+', ' ', 'g')"
    years = f"regexp_extract({text}, '^([0-9]+(?:\\.0+)?)\\+?\\s*years?$', 1)"
    return (f"CASE WHEN {missing(c)} THEN NULL "
            f"WHEN regexp_matches({text}, '^(<|less than)\\s*1\\s*year$') THEN 0.0 "
            f"WHEN {years} <> '' THEN CAST({years} AS DOUBLE) "
            f"WHEN regexp_matches({text}, '{NUMBER}') THEN CAST({text} AS DOUBLE) END")


def date(c: str) -> str:
    t = f"trim({c})"
    return (f"CASE WHEN {missing(c)} THEN NULL ELSE "
            f"coalesce(CASE WHEN length({t}) = 8 THEN try_strptime({t}, '%b-%Y') END, "
            f"CASE WHEN length({t}) = 6 THEN try_strptime({t}, '%b-%y') END, "
            f"try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, '%Y/%m/%d'), "
            f"try_strptime({t}, '%Y-%m-%d %H:%M:%S'), try_strptime({t}, '%Y-%m-%dT%H:%M:%S')) END")


def category(c: str, case: str) -> str:
    return (f"CASE WHEN {missing(c)} THEN '__MISSING__' "
            f"ELSE regexp_replace({case}(trim({c})), '\\s+', '_', 'g') END")


def grade(c: str) -> str:
    t = f"upper(trim({c}))"
    return f"CASE WHEN regexp_matches({t}, '^[A-G]$') THEN ascii({t}) - 65 ELSE -1 END"


def sub_grade(c: str) -> str:
    t = f"upper(trim({c}))"
    return (f"CASE WHEN regexp_matches({t}, '^[A-G][1-5]$') THEN (ascii({t}) - 65) * 5 "
            f"+ ascii(substr({t}, 2, 1)) - 49 ELSE -1 END")


_PARSED = ", ".join(
    [f"{number(c)} AS {c}" for c in S.MONEY_AND_COUNTS]
    + [f"{percent(c)} AS {c}" for c in S.PERCENTS]
    + [f"{term('term')} AS term", f"{emp_length('emp_length')} AS emp_length"]
)
_LONG_NUMERIC = " UNION ALL ".join(
    f"SELECT loan_id, issue_quarter, dataset_split, target, '{c}' AS feature, "
    f"coalesce({c}, (SELECT {c} FROM medians)) AS value, {c} IS NULL AS was_missing FROM labelled"
    for c in S.NUMERIC
)

CTES: dict[str, str] = {
    **binding.VIEWS,
    "resolved": f"""
SELECT *, CASE WHEN lower(trim(loan_status)) IN {quoted(S.DEFAULTED)} THEN 1 ELSE 0 END AS target
FROM loans_raw WHERE lower(trim(loan_status)) IN {quoted(S.DEFAULTED + S.REPAID)}""",
    "parsed": f"""
SELECT loan_id, target, {date('issue_d')} AS issue_d, {date('earliest_cr_line')} AS earliest,
  {_PARSED}, {grade('grade')} AS grade, {sub_grade('sub_grade')} AS sub_grade,
  {category('purpose', 'lower')} AS purpose, {category('home_ownership', 'upper')} AS home_ownership
FROM resolved""",
    "typed": """
SELECT * EXCLUDE (earliest),
  CAST(year(issue_d) AS VARCHAR) || 'Q' || CAST(quarter(issue_d) AS VARCHAR) AS issue_quarter,
  CASE WHEN annual_inc > 0 THEN loan_amnt / annual_inc END AS loan_to_income,
  CASE WHEN annual_inc > 0 THEN installment / (annual_inc / 12.0) END AS installment_to_income,
  CASE WHEN issue_d >= earliest
    THEN CAST(date_diff('second', earliest, issue_d) AS DOUBLE) / (365.25 * 86400) END
    AS credit_history_years
FROM parsed""",
    "quarters": """
SELECT issue_quarter, count(*) AS loans, row_number() OVER (ORDER BY issue_quarter) AS q_index,
  count(*) OVER () AS n FROM typed GROUP BY issue_quarter""",
    "split_quarters": """
SELECT issue_quarter, loans, q_index,
  CASE WHEN q_index <= floor(n * 0.6) THEN 'train'
    WHEN q_index <= floor(n * 0.6) + floor(n * 0.2) THEN 'validation' ELSE 'shift' END
    AS dataset_split FROM quarters""",
    "labelled": """
SELECT t.*, s.dataset_split FROM typed t JOIN split_quarters s USING (issue_quarter)""",
    "medians": "SELECT " + ", ".join(f"median({c}) AS {c}" for c in S.NUMERIC)
    + " FROM labelled WHERE dataset_split = 'train'",
    "vocab": """
SELECT DISTINCT 'purpose' AS column_name, purpose AS category
FROM labelled WHERE dataset_split = 'train'
UNION SELECT DISTINCT 'home_ownership', home_ownership
FROM labelled WHERE dataset_split = 'train'""",
    "long_numeric": _LONG_NUMERIC,
    "long_one_hot": """
SELECT l.loan_id, l.issue_quarter, l.dataset_split, l.target,
  v.column_name || '_' || v.category AS feature,
  CASE WHEN v.category = CASE v.column_name WHEN 'purpose' THEN l.purpose ELSE l.home_ownership END
    THEN 1.0 ELSE 0.0 END AS value
FROM labelled l CROSS JOIN vocab v""",
    "long_features": """
SELECT loan_id, issue_quarter, dataset_split, target, feature, value FROM long_numeric
UNION ALL SELECT loan_id, issue_quarter, dataset_split, target, feature || '_was_missing',
  CASE WHEN was_missing THEN 1.0 ELSE 0.0 END FROM long_numeric
UNION ALL SELECT loan_id, issue_quarter, dataset_split, target, 'grade', grade FROM labelled
UNION ALL SELECT loan_id, issue_quarter, dataset_split, target, 'sub_grade', sub_grade FROM labelled
UNION ALL SELECT loan_id, issue_quarter, dataset_split, target, feature, value FROM long_one_hot""",
    "scaler": """
SELECT feature, avg(value) AS mean,
  CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
FROM long_features WHERE dataset_split = 'train' GROUP BY feature""",
    "scaled": """
SELECT f.*, (f.value - s.mean) / s.scale AS scaled FROM long_features f JOIN scaler s USING (feature)""",
    "latest_prediction": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY application_id
  ORDER BY created_at DESC, prediction_id DESC) AS rn FROM predictions) WHERE rn = 1""",
    "latest_feedback": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id
  ORDER BY version DESC, created_at DESC) AS rn FROM feedback) WHERE rn = 1""",
    "statuses": """
SELECT a.*, p.prediction_id AS latest_prediction_id, p.score, p.risk_flag,
  f.decision AS current_decision,
  CASE WHEN f.decision = 'escalate' THEN 'escalated' WHEN f.decision IS NOT NULL THEN 'decided'
    WHEN p.prediction_id IS NOT NULL THEN 'scored' ELSE 'unscored' END AS status
FROM applications a LEFT JOIN latest_prediction p USING (application_id)
LEFT JOIN latest_feedback f ON f.prediction_id = p.prediction_id""",
    "graded": "SELECT * FROM predictions WHERE target IS NOT NULL",
    "curve": """
SELECT score, positives, negatives,
  sum(positives) OVER (ORDER BY score DESC) AS tp, sum(negatives) OVER (ORDER BY score DESC) AS fp
FROM (SELECT score, count(*) FILTER (target = 1) AS positives,
  count(*) FILTER (target = 0) AS negatives FROM graded GROUP BY score)""",
    "cohort_stack": """
SELECT 'score' AS feature, score AS value, created_at < TIMESTAMP '1999-01-01' AS is_reference
FROM predictions
UNION ALL SELECT 'o_totalprice', o_totalprice, o_orderdate < TIMESTAMP '1999-01-01'
FROM orders
UNION ALL SELECT 'prediction_id', prediction_id, created_at < TIMESTAMP '1999-01-01'
FROM predictions""",
    "snapshot_entries": """
SELECT snapshot_id, created_at,
  'feature_' || CAST(CAST(json_extract_string(snapshot, '$.k') AS BIGINT) % 7 AS VARCHAR) AS feature
FROM monitoring_snapshots
UNION ALL SELECT snapshot_id, created_at, 'feature_' || CAST(snapshot_id % 11 AS VARCHAR)
FROM monitoring_snapshots WHERE snapshot_id % 2 = 0""",
}


def needed(sql: str) -> list[str]:
    """CTE names a query uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                found.append(name)

    visit(sql)
    return found


def sql(body: str) -> str:
    names = needed(body)
    if not names:
        return body
    own = re.match(r"\s*WITH\s+", body)
    body = ",\n" + body[own.end():] if own else "\n" + body
    # Materialised: several expressions read the same CTE.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in names)
    return f"WITH {ctes}{body}"
