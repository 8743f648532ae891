import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, "ledgerlens-tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw_loans(spark):
    """Nine hand-made loans; eight have a known outcome."""
    dates = ["Jan-2016", "Apr-2016", "Jul-2016", "Oct-2016", "Jan-2017", "Apr-2017", "Jul-2017",
             "Oct-2017", "Nov-2017"]
    statuses = ["Fully Paid", "Charged Off", "Default", "Fully Paid", "Fully Paid", "Charged Off",
                "Fully Paid", "Default", "Current"]
    rows = []
    for n in range(9):
        emp = "10+ years" if n == 2 else "< 1 year" if n == 0 else f"{min(n, 10)} years"
        rows.append({
            "loan_id": n, "annual_inc": None if n == 1 else str(60000 + 1000 * n),
            "dti": str(12 + n), "revol_util": f"{30 + n}%", "revol_bal": str(5000 + 100 * n),
            "open_acc": str(8 + n), "total_acc": str(18 + n), "delinq_2yrs": str(n % 2),
            "inq_last_6mths": str(n % 3), "loan_amnt": str(10000 + 250 * n),
            "term": f" {36 if n % 2 == 0 else 60} months", "int_rate": f"{9.5 + n / 2}%",
            "installment": str(315 + 5 * n), "grade": "ABCDEFG"[n % 7],
            "sub_grade": "ABCDEFG"[n % 7] + str(n % 5 + 1),
            "purpose": "debt_consolidation" if n % 2 == 0 else "credit_card", "emp_length": emp,
            "home_ownership": "RENT" if n % 2 == 0 else "MORTGAGE",
            "earliest_cr_line": "Jan-2000", "issue_d": dates[n], "loan_status": statuses[n],
            "recoveries": "0", "total_pymnt": "1", "last_pymnt_d": "Jan-2019",
        })
    columns = list(rows[0])
    schema = ", ".join(f"`{c}` {'bigint' if c == 'loan_id' else 'string'}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
