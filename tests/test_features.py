"""Parsing, outcomes, splits, fitted state and dictionary on nine loans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.errors import DataContractError
from ledgerlens.functions import derive, parse
from ledgerlens.operators import dictionary, features, outcomes, splits


def labelled(raw):
    typed = features.type_columns(outcomes.resolve(raw))
    return splits.plan_split(typed).apply(typed)


def one(spark, value, column):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(column(F.col("v")).alias("r")).first()["r"]


def test_outcomes_and_typed_values(raw_loans):
    rows = features.type_columns(outcomes.resolve(raw_loans)).orderBy("loan_id").collect()
    assert [r["target"] for r in rows] == [0, 1, 1, 0, 0, 1, 0, 1]
    first = rows[0]
    assert (first["term"], first["int_rate"], first["revol_util"], first["emp_length"]) == (
        36, 9.5, 30, 0)
    assert first["loan_to_income"] == pytest.approx(1 / 6)
    assert first["installment_to_income"] == pytest.approx(315 / 5000)
    assert first["credit_history_years"] == pytest.approx(16, abs=0.01)
    assert (first["grade"], first["sub_grade"]) == (0, 0)
    assert rows[1]["loan_to_income"] is None
    assert rows[2]["emp_length"] == 10


@pytest.mark.parametrize("text, expected", [
    ("Jan-2018", dt.datetime(2018, 1, 1)), ("feb-99", dt.datetime(1999, 2, 1)),
    ("MAR-68", dt.datetime(2068, 3, 1)), ("Apr-69", dt.datetime(1969, 4, 1)),
    ("2018-1-5", dt.datetime(2018, 1, 5)), ("2018/02/03", dt.datetime(2018, 2, 3)),
    (" 2018-01-05 03:04:05 ", dt.datetime(2018, 1, 5, 3, 4, 5)),
    ("2018-01-05T03:04:05", dt.datetime(2018, 1, 5, 3, 4, 5)),
    ("n/a", None), ("", None), ("2018-02-31", None), ("Jan-2018x", None), ("Xyz-2018", None),
    ("2018/01-05", None), ("2018-01-05T", None),
])
def test_dates(spark, text, expected):
    assert one(spark, text, parse.parse_date) == expected


@pytest.mark.parametrize("text, expected", [
    ("$1,234.5", 1234.5), (" 7 ", 7.0), ("1e3", 1000.0), ("12d", None), ("Infinity", None),
    ("nan", None), ("-3", -3.0), ("1e999", None), ("\t5\n", 5.0),
])
def test_numbers(spark, text, expected):
    assert one(spark, text, parse.parse_number) == expected


@pytest.mark.parametrize("text, expected", [
    ("< 1 year", 0.0), ("less than 1 year", 0.0), ("10+ years", 10.0), ("1 year", 1.0),
    ("3", 3.0), ("2  Years", 2.0), ("n/a", None), ("many", None),
])
def test_emp_length(spark, text, expected):
    assert one(spark, text, parse.parse_emp_length) == expected


def test_unparsable_is_not_missing(spark):
    bad = lambda c: parse.unparsable(c, parse.parse_number)
    assert one(spark, "abc", bad) is True
    assert one(spark, "N/A", bad) is False
    assert one(spark, None, bad) is False


def test_term_percent_category_grade(spark):
    assert one(spark, " 36 months", parse.parse_term) == 36
    assert one(spark, "36 weeks", parse.parse_term) is None
    assert one(spark, "11.2 %", parse.parse_percent) == 11.2
    assert one(spark, " Debt  Consolidation ",
               lambda c: parse.normalise_category(c, "purpose")) == "debt_consolidation"
    assert one(spark, "none", lambda c: parse.normalise_category(c, "home_ownership")) \
        == S.MISSING_CATEGORY
    assert one(spark, " g5 ", parse.sub_grade_ordinal) == 34
    assert one(spark, "H", parse.grade_ordinal) == -1
    assert one(spark, None, parse.grade_ordinal) == -1


def test_split_counts(raw_loans):
    plan = splits.plan_split(features.type_columns(outcomes.resolve(raw_loans)))
    assert plan.by_split == {
        "train": ("2016Q1", "2016Q2", "2016Q3", "2016Q4"), "validation": ("2017Q1",),
        "shift": ("2017Q2", "2017Q3", "2017Q4")}
    counts = labelled(raw_loans).groupBy(S.SPLIT).count().collect()
    assert {r[0]: r[1] for r in counts} == {"train": 4, "validation": 1, "shift": 3}


@pytest.mark.parametrize("total, fractions, expected", [
    (3, (0.6, 0.2), (1, 1)), (3, (0.05, 0.9), (1, 1)), (3, (0.9, 0.05), (1, 1)),
    (10, (0.6, 0.2), (6, 2)), (4, (0.05, 0.9), (1, 2)), (27, (0.6, 0.2), (16, 5)),
])
def test_quarter_counts_eager_and_lazy(spark, total, fractions, expected):
    assert splits.quarter_counts(total, *fractions) == expected
    frame = spark.createDataFrame([(f"{2000 + i}Q1",) for i in range(total)], "issue_quarter string")
    rows = splits.quarter_table(frame, train=fractions[0], validation=fractions[1]).collect()
    sizes = [sum(r[S.SPLIT] == s for r in rows) for s in ("train", "validation")]
    assert tuple(sizes) == expected


def test_split_errors():
    with pytest.raises(DataContractError):
        splits.quarter_counts(2)
    with pytest.raises(DataContractError):
        splits.check_fractions(0.6, 0.5)
    with pytest.raises(DataContractError):
        splits.check_fractions(0.6, 0.2, 0.3)


def test_folds_eager_and_lazy(spark):
    quarters = [f"{2000 + i // 4}Q{i % 4 + 1}" for i in range(18)]
    folds = splits.expanding_folds(quarters, 3)
    assert [len(f.validation) for f in folds] == [5, 4, 4]
    assert [len(f.train) for f in folds] == [5, 10, 14]
    frame = spark.createDataFrame([(q,) for q in quarters], "issue_quarter string")
    lazy = splits.fold_table(frame, 3).collect()
    for fold in folds:
        for role in ("train", "validation"):
            got = sorted(r[S.QUARTER] for r in lazy if (r["fold"], r["role"]) == (fold.index, role))
            assert got == list(getattr(fold, role))
    six = splits.expanding_folds(["2020Q1", "2020Q2", "2020Q3", "2020Q4", "2021Q1", "2021Q2"], 2)
    assert six[0].train == ("2020Q1", "2020Q2") and six[0].validation == ("2020Q3", "2020Q4")
    assert six[1].validation == ("2021Q1", "2021Q2")


def test_fit_transform_and_round_trip(spark, raw_loans, tmp_path):
    frame = labelled(raw_loans)
    fitted = features.fit(frame.filter(F.col(S.SPLIT) == "train"))
    assert fitted.training_rows == 4
    assert len(fitted.feature_names) == 34 + 4
    unscaled = fitted.transform(frame)
    rows = unscaled.collect()
    assert all(v is not None for r in rows for v in r)
    means = fitted.scale(unscaled).filter(F.col(S.SPLIT) == "train").agg(
        *[F.abs(F.avg(c)).alias(c) for c in fitted.feature_names]).first()
    assert max(means) < 1e-9
    path = str(tmp_path / "state")
    fitted.save(spark, path)
    loaded = features.Preprocessor.load(spark, path)
    assert loaded == fitted
    assert loaded.transform(frame).collect() == rows


def test_unknown_category_is_all_zero(spark, raw_loans):
    frame = labelled(raw_loans)
    fitted = features.fit(frame.filter(F.col(S.SPLIT) == "train"))
    odd = frame.withColumn("purpose", F.lit("yacht")).withColumn("home_ownership", F.lit("BOAT"))
    hot = list(fitted.one_hot_names)
    assert all(v == 0 for r in fitted.transform(odd).select(*hot).collect() for v in r)


def test_fit_does_not_see_later_rows(raw_loans):
    frame = labelled(raw_loans)
    train = frame.filter(F.col(S.SPLIT) == "train")
    later = frame.withColumn("dti", F.when(F.col(S.SPLIT) == "train", F.col("dti")).otherwise(999.0))
    assert features.fit(train) == features.fit(later.filter(F.col(S.SPLIT) == "train"))


def test_contract_errors(raw_loans):
    with pytest.raises(DataContractError, match="missing required"):
        outcomes.select_allowed(raw_loans.drop("dti"))
    with pytest.raises(DataContractError, match="no resolved"):
        outcomes.require_resolved(raw_loans.withColumn("loan_status", F.lit("Current")))
    bad = raw_loans.withColumn("issue_d", F.lit("someday"))
    with pytest.raises(DataContractError, match="someday"):
        features.require_parsable(bad)
    with pytest.raises(DataContractError, match="required for every"):
        features.require_parsable(raw_loans.withColumn("issue_d", F.lit("n/a")))
    with pytest.raises(DataContractError, match="without any value"):
        features.fit(labelled(raw_loans.withColumn("dti", F.lit("n/a"))))
    with pytest.raises(DataContractError):
        outcomes.refuse_leakage(["dti", "recoveries"])
    with pytest.raises(DataContractError, match="categories"):
        features.fit_vocabulary(labelled(raw_loans), limit=1)


def test_vocabulary_has_no_bound_of_its_own(spark):
    typed = spark.range(1500).select(*[
        F.concat(F.lit("V"), F.col("id") % (1500 if c == S.CATEGORIES[0] else 2)).alias(c)
        for c in S.CATEGORIES])
    found = features.fit_vocabulary(typed)
    assert len(found[S.CATEGORIES[0]]) == 1500
    assert all(found[c] == ["V0", "V1"] for c in S.CATEGORIES[1:])


def test_allow_list_ignores_the_rest(raw_loans):
    kept = outcomes.select_allowed(raw_loans)
    assert kept.columns == ["loan_id", *sorted(S.ALLOWED)]
    assert outcomes.ignored_columns(raw_loans) == ["last_pymnt_d", "recoveries", "total_pymnt"]


def test_dictionary(raw_loans):
    frame = labelled(raw_loans)
    fitted = features.fit(frame.filter(F.col(S.SPLIT) == "train"))
    rows = {r["feature_name"]: r for r in
            dictionary.data_dictionary(raw_loans, frame, fitted).collect()}
    assert len(rows) == len(fitted.feature_names) + 3 + len(S.POST_ORIGINATION)
    assert rows["annual_inc"]["null_rate"] == 1 / 8
    assert rows["loan_to_income"]["null_rate"] == 1 / 8
    assert rows["collection_recovery_fee"]["null_rate"] is None
    assert rows["recoveries"]["leakage_risk_flag"] and rows["recoveries"]["null_rate"] == 0


def test_composition_counts_bad_dates(spark):
    frame = spark.createDataFrame(
        [("Fully Paid", "Jan-2018"), ("Charged Off", "Apr-2018"), ("default", "Jul-2018"),
         ("Current", "Oct-2018"), ("Default", "whenever")], "loan_status string, issue_d string")
    rows = {r[S.QUARTER]: (r["resolved_loans"], r["defaults"])
            for r in outcomes.quarterly_composition(frame).collect()}
    assert rows == {"2018Q1": (1, 0), "2018Q2": (1, 1), "2018Q3": (1, 1), None: (1, 1)}
    balance = {r["target"]: r["loans"] for r in outcomes.class_balance(frame).collect()}
    assert balance == {0: 1, 1: 3}


def test_labels(spark):
    frame = spark.createDataFrame([(dt.datetime(2018, 5, 7),)], "d timestamp")
    row = frame.select(derive.quarter_label("d").alias("q"), derive.month_label("d").alias("m")).first()
    assert (row["q"], row["m"]) == ("2018Q2", "2018-05")
    assert one(spark, "int_rate_was_missing", derive.display_name) == "int rate missingness"
    assert one(spark, "dti", derive.display_name) == "debt-to-income ratio"


def test_numbers_are_read_without_looking_up_each_character(spark):
    texts = [" $1,234.5 ", "$ 12", "1e3", "12d", "NaN", "1\n", "$", "-+", "5 %", "٣", " 7\t", "1,0%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse.parse_number("t")).collect()]
    assert got == [1234.5, 12.0, 1000.0, None, None, 1.0, None, None, None, None, 7.0, None]
    got = [r[0] for r in df.select(parse.parse_percent("t")).collect()]
    assert got == [1234.5, 12.0, 1000.0, None, None, 1.0, None, None, 5.0, None, 7.0, 10.0]
    plan = df.select(parse.parse_number("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in plan.lower()
