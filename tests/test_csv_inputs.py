"""CSV files that queries write for themselves."""

from ledgerlens.plans import feature_queries
from ledgerlens.plans.inputs import Inputs

SMOKE = "/root/testdata/sf0.001"


def test_files_follow_the_partitions_or_a_fixed_number(spark):
    kept = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.shuffle.partitions")}
    for key, value in zip(kept, ("false", "-1", "7")):
        spark.conf.set(key, value)
    try:
        x = Inputs(spark, SMOKE)
        loans = x.loans().count()
        for files, expected in ((None, 7), (4, 4)):
            paths = feature_queries._csv_loans(x, "files", files=files)
            assert len(paths) == expected
            assert spark.read.option("header", True).csv(paths).count() == loans
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
