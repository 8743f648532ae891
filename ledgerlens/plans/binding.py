"""Loan-shaped and review-shaped views over the star-schema test tables.

The texts run unchanged on Spark and on DuckDB, so a query and its oracle start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "customer", "lineitem", "events", "nation")

VIEWS = {
    "loans_raw": """
SELECT o.o_orderkey AS loan_id,
  CASE o.o_orderstatus WHEN 'F' THEN ' Fully Paid ' WHEN 'P' THEN
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'Default' ELSE 'charged off' END ELSE 'Current' END AS loan_status,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((month(o.o_orderdate) - 1) * 3 + 1 AS INT), 3)
    || '-' || CAST(year(o.o_orderdate) AS STRING) AS issue_d,
  CASE o.o_orderkey % 4
    WHEN 0 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((c.c_custkey % 12) * 3 + 1 AS INT), 3)
      || '-' || CAST(1960 + c.c_custkey % 42 AS STRING)
    WHEN 1 THEN CAST(1960 + c.c_custkey % 42 AS STRING) || '-' || lpad(CAST(c.c_custkey % 12 + 1 AS STRING), 2, '0') || '-01'
    WHEN 2 THEN substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((c.c_custkey % 12) * 3 + 1 AS INT), 3)
      || '-' || lpad(CAST((1960 + c.c_custkey % 42) % 100 AS STRING), 2, '0')
    ELSE 'n/a' END AS earliest_cr_line,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE '$' || CAST(CAST(floor(c.c_acctbal * 10) AS BIGINT) AS STRING) END AS annual_inc,
  CAST(l.q % 46 AS STRING) AS dti,
  CAST(CAST(round(l.t * 1000) AS INT) AS STRING) || '%' AS revol_util,
  CAST(CAST(floor(o.o_totalprice / 7) AS BIGINT) AS STRING) AS revol_bal,
  CAST(l.n AS STRING) AS open_acc, CAST(l.n + c.c_nationkey AS STRING) AS total_acc,
  CAST(c.c_custkey % 4 AS STRING) AS delinq_2yrs, CAST(o.o_orderkey % 5 AS STRING) AS inq_last_6mths,
  CAST(CAST(floor(o.o_totalprice / 10) AS BIGINT) AS STRING) AS loan_amnt,
  CASE WHEN o.o_orderkey % 2 = 0 THEN ' 36 months' ELSE '60' END AS term,
  CAST(CAST(round(5 + l.d * 200) AS INT) AS STRING) || '.5%' AS int_rate,
  CAST(CAST(floor(o.o_totalprice / 360) AS BIGINT) AS STRING) AS installment,
  substr('ABCDEFGH', CAST(c.c_nationkey % 8 + 1 AS INT), 1) AS grade,
  substr('ABCDEFGH', CAST(c.c_nationkey % 8 + 1 AS INT), 1) || CAST(o.o_orderkey % 6 AS STRING) AS sub_grade,
  c.c_mktsegment AS purpose,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN '< 1 year' WHEN '2-HIGH' THEN '2 years'
    WHEN '3-MEDIUM' THEN '10+ years' WHEN '5-LOW' THEN '1 year' ELSE 'n/a' END AS emp_length,
  CASE c.c_nationkey % 4 WHEN 0 THEN 'rent' WHEN 1 THEN 'Mortgage' WHEN 2 THEN 'own' ELSE NULL END AS home_ownership
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_discount) AS d, max(l_tax) AS t
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
""",
    "applications": """
SELECT c_custkey AS application_id, c_name AS external_reference, c_nationkey AS created_by_id,
  coalesce(min(o_orderdate), TIMESTAMP '1992-01-01') AS created_at
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_nationkey
""",
    "predictions": """
SELECT o_orderkey AS prediction_id, o_custkey AS application_id, c_nationkey AS requested_by_id,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) >= CAST(0.5093 AS DOUBLE) AS risk_flag,
  CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS target,
  o_orderdate AS created_at
FROM orders JOIN customer ON c_custkey = o_custkey
""",
    "feedback": """
SELECT l_orderkey * 1000 + version AS feedback_id, l_orderkey AS prediction_id, CAST(version AS INT) AS version,
  CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'R' THEN 'decline' ELSE 'escalate' END AS decision,
  CASE WHEN l_quantity < 5 THEN NULL ELSE l_linestatus = 'F' END AS agreed_with_model,
  CASE WHEN l_quantity > 40 THEN NULL ELSE 'note' END AS note, l_shipdate AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version FROM lineitem) x
""",
    "monitoring_snapshots": """
SELECT event_id AS snapshot_id, CASE WHEN event_type = 'error' THEN 'feature_drift' ELSE 'score_observation' END AS source,
  CASE WHEN value >= 150 THEN 'drift_detected' ELSE 'stable' END AS status, ts AS created_at, props AS snapshot
FROM events
""",
    "retraining_tickets": """
SELECT event_id AS ticket_id, user_id AS requested_by_id,
  CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, ts AS created_at
FROM events WHERE event_type = 'signup'
""",
    "score_stream": """
SELECT event_id AS prediction_id, 's2-' || CAST(user_id % 4 AS STRING) AS model_version,
  CASE WHEN value > 500 THEN CAST(1 AS DOUBLE) ELSE value / CAST(500 AS DOUBLE) END AS score, ts AS created_at
FROM events
""",
    "users": """
SELECT n_nationkey AS user_id, n_name AS username,
  CASE n_regionkey % 3 WHEN 0 THEN 'loan_officer' WHEN 1 THEN 'risk_analyst' ELSE 'admin' END AS role, n_nationkey % 7 <> 0 AS is_active
FROM nation
""",
    "audit_events": """
SELECT event_id AS audit_id, CAST(user_id % 40 AS INT) AS actor_user_id, event_type AS action, ts AS created_at FROM events
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bind one view; Catalyst prunes the columns a query does not touch."""
    frames = {
        base: table(spark, sf_dir, base) for base in TABLES if f" {base}" in VIEWS[name]
    }
    text = VIEWS[name]
    for base, frame in frames.items():
        frame.createOrReplaceTempView(base)
    return spark.sql(text)
