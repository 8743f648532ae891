"""Queries over raw loans: parsing, features, splits, store, perturbation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions import derive, parse
from ledgerlens.operators import (
    dictionary,
    evidence,
    features,
    outcomes,
    perturb,
    splits,
    store,
)
from ledgerlens.operators.windows import TimeWindow
from ledgerlens.plans import oracle as O
from ledgerlens.plans.inputs import Inputs, longs, rounded, text_time, unpivot
from ledgerlens.plans.registry import Registry
from ledgerlens.session import materialise, scratch
from ledgerlens.sources import inventory, loans

QUERIES = Registry()
query = QUERIES.add


def _each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("null_tokens", _each(
    S.ALLOWED,
    "SELECT '{c}' AS column_name, count(*) FILTER (" + O.missing("{c}")
    + ") AS missing_rows FROM loans_raw"))
def null_tokens(x: Inputs) -> DataFrame:
    row = x.loans().agg(*[
        F.count_if(parse.is_missing(parse.file_nulls(c))).alias(c) for c in S.ALLOWED
    ])
    return unpivot(row, list(S.ALLOWED), "column_name", "missing_rows")


@query("allowlist_projection",
       "SELECT loan_id, " + ", ".join(S.ALLOWED) + " FROM loans_raw")
def allowlist_projection(x: Inputs) -> DataFrame:
    wide = x.loans().withColumn("recoveries", F.lit("0")).withColumn("surprise", F.lit(1))
    return outcomes.select_allowed(wide)


@query("resolve_outcomes", "SELECT loan_id, CAST(target AS BIGINT) AS target FROM resolved")
def resolve_outcomes(x: Inputs) -> DataFrame:
    return outcomes.resolve(x.loans()).select("loan_id", *longs_of_target())


def longs_of_target() -> list:
    return [F.col(S.TARGET).cast("long").alias(S.TARGET)]


@query("status_inventory", """
SELECT coalesce(lower(trim(loan_status)), '<missing>') AS status, count(*) AS loans
FROM loans_raw GROUP BY 1""")
def status_inventory(x: Inputs) -> DataFrame:
    return outcomes.status_inventory(x.loans())


@query("class_balance", """
SELECT c.target, c.class_label, c.loans, round(c.loans / (sum(c.loans) OVER ()), 6) AS share FROM (
  SELECT CAST(0 AS BIGINT) AS target, 'Fully Paid' AS class_label,
    count(*) FILTER (target = 0) AS loans FROM resolved
  UNION ALL SELECT 1, 'Default or Charged Off', count(*) FILTER (target = 1) FROM resolved) c""")
def class_balance(x: Inputs) -> DataFrame:
    return outcomes.class_balance(x.loans()).select(
        *longs_of_target(), "class_label", "loans", *rounded("share"))


@query("quarterly_composition", """
SELECT issue_quarter, count(*) AS resolved_loans, CAST(sum(target) AS BIGINT) AS defaults,
  round(avg(target), 6) AS default_rate FROM typed GROUP BY issue_quarter""")
def quarterly_composition(x: Inputs) -> DataFrame:
    return outcomes.quarterly_composition(x.loans()).select(
        S.QUARTER, "resolved_loans", "defaults", *rounded("default_rate"))


_DATE_TEXT = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


@query("parse_dates", f"""
SELECT loan_id, strftime({O.date('issue_d')}, '%Y-%m-%d %H:%M:%S') AS issue_d,
  strftime({O.date('earliest_cr_line')}, '%Y-%m-%d %H:%M:%S') AS earliest_cr_line
FROM loans_raw""")
def parse_dates(x: Inputs) -> DataFrame:
    return x.loans().select(
        "loan_id",
        parse.parse_date("issue_d").alias("issue_d"),
        parse.parse_date("earliest_cr_line").alias("earliest_cr_line"),
    ).select("loan_id", text_time("issue_d"), text_time("earliest_cr_line"))


def _parsed(x: Inputs, *columns: str) -> DataFrame:
    return x.loans().select(
        "loan_id",
        *[parse.PARSERS[c](c).alias(c) for c in columns],
        *[parse.unparsable(c, parse.PARSERS[c]).alias(f"{c}_bad") for c in columns],
    )


def _parsed_sql(columns, parser) -> str:
    return "SELECT loan_id, " + ", ".join(
        f"{parser(c)} AS {c}, NOT {O.missing(c)} AND ({parser(c)}) IS NULL AS {c}_bad"
        for c in columns
    ) + " FROM loans_raw"


@query("parse_numeric", _parsed_sql(S.MONEY_AND_COUNTS, O.number))
def parse_numeric(x: Inputs) -> DataFrame:
    return _parsed(x, *S.MONEY_AND_COUNTS)


@query("parse_percent", _parsed_sql(S.PERCENTS, O.percent))
def parse_percent(x: Inputs) -> DataFrame:
    return _parsed(x, *S.PERCENTS)


@query("parse_term", _parsed_sql(["term"], O.term))
def parse_term(x: Inputs) -> DataFrame:
    return _parsed(x, "term")


@query("parse_emp_length", _parsed_sql(["emp_length"], O.emp_length))
def parse_emp_length(x: Inputs) -> DataFrame:
    return _parsed(x, "emp_length")


@query("normalise_category", f"""
SELECT loan_id, {O.category('purpose', 'lower')} AS purpose,
  {O.category('home_ownership', 'upper')} AS home_ownership FROM loans_raw""")
def normalise_category(x: Inputs) -> DataFrame:
    return x.loans().select(
        "loan_id", *[parse.normalise_category(c, c).alias(c) for c in S.CATEGORIES])


@query("grade_ordinal", f"""
SELECT loan_id, CAST({O.grade('grade')} AS BIGINT) AS grade,
  CAST({O.sub_grade('sub_grade')} AS BIGINT) AS sub_grade FROM loans_raw""")
def grade_ordinal(x: Inputs) -> DataFrame:
    return x.loans().select(
        "loan_id", parse.grade_ordinal("grade").cast("long").alias("grade"),
        parse.sub_grade_ordinal("sub_grade").cast("long").alias("sub_grade"))


@query("income_ratios", """
SELECT loan_id, round(loan_to_income, 6) AS loan_to_income,
  round(installment_to_income, 6) AS installment_to_income FROM typed""")
def income_ratios(x: Inputs) -> DataFrame:
    return x.typed().select("loan_id", *rounded("loan_to_income", "installment_to_income"))


@query("credit_history",
       "SELECT loan_id, round(credit_history_years, 6) AS credit_history_years FROM typed")
def credit_history(x: Inputs) -> DataFrame:
    return x.typed().select("loan_id", *rounded("credit_history_years"))


@query("finite_or_null", """
SELECT loan_id, CASE WHEN loan_id % 7 IN (0, 1) OR loan_id % 11 = 0 THEN NULL ELSE dti END AS value
FROM typed""")
def finite_or_null(x: Inputs) -> DataFrame:
    inf = float("inf")
    spoiled = (
        F.when(F.col("loan_id") % 7 == 0, F.lit(inf))
        .when(F.col("loan_id") % 7 == 1, F.lit(-inf))
        .when(F.col("loan_id") % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("dti"))
    )
    return x.typed().select("loan_id", parse.finite_or_null(spoiled).alias("value"))


@query("quarter_label", """
SELECT loan_id, issue_quarter, strftime(issue_d, '%Y-%m') AS issue_month FROM typed""")
def quarter_label(x: Inputs) -> DataFrame:
    return x.typed().select(
        "loan_id", derive.quarter_label("issue_d").alias(S.QUARTER),
        derive.month_label("issue_d").alias("issue_month"))


@query("missing_flags", "SELECT loan_id, " + ", ".join(
    f"CAST({c} IS NULL AS BIGINT) AS {S.missing_flag(c)}" for c in S.NUMERIC) + " FROM typed")
def missing_flags(x: Inputs) -> DataFrame:
    return x.typed().select("loan_id", *[
        features.missing_indicator(c).cast("long").alias(S.missing_flag(c)) for c in S.NUMERIC])


@query("temporal_split", """
SELECT issue_quarter, loans, q_index, dataset_split FROM split_quarters""")
def temporal_split(x: Inputs) -> DataFrame:
    return splits.quarter_table(x.typed()).select(
        S.QUARTER, "loans", *longs("q_index"), S.SPLIT)


@query("train_medians", _each(
    S.NUMERIC, "SELECT '{c}' AS feature, round({c}, 6) AS median FROM medians"))
def train_medians(x: Inputs) -> DataFrame:
    train = x.split(stored=True).filter(F.col(S.SPLIT) == "train")
    found = features.fit_medians(train, row_bound=x.plan.train_rows)
    return x.spark.createDataFrame(
        [(c, round(v, 6)) for c, v in found.items()], "feature string, median double")


@query("train_vocab", "SELECT column_name, category FROM vocab")
def train_vocab(x: Inputs) -> DataFrame:
    return features.vocabulary_rows(x.split().filter(F.col(S.SPLIT) == "train"))


@query("train_scaler",
       "SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM scaler")
def train_scaler(x: Inputs) -> DataFrame:
    train = x.split(stored=True).filter(F.col(S.SPLIT) == "train")
    partial = features.Preprocessor(
        features.fit_medians(train, row_bound=x.plan.train_rows),
        features.fit_vocabulary(train))
    names = partial.feature_names
    row = features.scaler_aggregates(train.select(*partial.feature_columns()), names)
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"mean_{n}").alias("mean"),
                 F.col(f"scale_{n}").alias("scale")) for n in names
    ])
    return row.select(F.explode(entries).alias("e")).select(
        "e.feature", "e.mean", "e.scale").select("feature", *rounded("mean", "scale"))


@query("impute", "SELECT loan_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT {c} FROM medians)), 6) AS {c}" for c in S.NUMERIC)
    + " FROM labelled")
def impute(x: Inputs) -> DataFrame:
    labelled = x.split(stored=True)
    medians = features.fit_medians(
        labelled.filter(F.col(S.SPLIT) == "train"), row_bound=x.plan.train_rows)
    return labelled.select(
        "loan_id", *[features.impute(c, medians[c]).alias(c) for c in S.NUMERIC]
    ).select("loan_id", *rounded(*S.NUMERIC))


@query("one_hot", """
SELECT dataset_split, feature, count(*) AS loans, CAST(sum(value) AS BIGINT) AS ones
FROM long_one_hot GROUP BY dataset_split, feature""")
def one_hot(x: Inputs) -> DataFrame:
    labelled = x.split(stored=True)
    vocabulary = features.fit_vocabulary(labelled.filter(F.col(S.SPLIT) == "train"))
    names = features.Preprocessor({}, vocabulary).one_hot_names
    counts = labelled.groupBy(S.SPLIT).agg(
        F.count(F.lit(1)).alias("loans"),
        *[F.sum(features.one_hot(c, v)).cast("long").alias(n) for n, (c, v) in names.items()])
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("ones")) for n in names])
    return counts.select(S.SPLIT, "loans", F.explode(entries).alias("e")).select(
        S.SPLIT, "e.feature", "loans", "e.ones")


@query("scale_features", """
SELECT feature, dataset_split, count(*) AS loans, round(avg(scaled), 5) AS mean,
  round(min(scaled), 5) AS lowest, round(max(scaled), 5) AS highest
FROM scaled GROUP BY feature, dataset_split""")
def scale_features(x: Inputs) -> DataFrame:
    _, scaled, preprocessor = x.views()
    names = preprocessor.feature_names
    stats = scaled.groupBy(S.SPLIT).agg(
        F.count(F.lit(1)).alias("loans"),
        *[F.struct(F.avg(n).alias("mean"), F.min(n).alias("lowest"), F.max(n).alias("highest"))
          .alias(n) for n in names])
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("s")) for n in names])
    return stats.select(S.SPLIT, "loans", F.explode(entries).alias("e")).select(
        "e.feature", S.SPLIT, "loans", "e.s.mean", "e.s.lowest", "e.s.highest"
    ).select("feature", S.SPLIT, "loans", *rounded("mean", "lowest", "highest", digits=5))


@query("null_rates", _each(
    S.ALLOWED,
    "SELECT '{c}' AS column_name, round(avg(CASE WHEN " + O.missing("{c}")
    + " THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM resolved"))
def null_rates(x: Inputs) -> DataFrame:
    return dictionary.raw_null_rates(x.loans()).select("column_name", *rounded("null_rate"))


def _dictionary_sql() -> str:
    def rate(c: str) -> str:
        return (f"(SELECT avg(CASE WHEN {O.missing(c)} THEN 1.0 ELSE 0.0 END) FROM resolved)")

    def typed_rate(c: str) -> str:
        return f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM typed)"

    rows = []

    def row(name, dtype, source, null_rate, text, flag):
        rows.append(
            f"SELECT '{name}' AS feature_name, '{dtype}' AS dtype, '{source}' AS source_column, "
            f"round({null_rate}, 6) AS null_rate, '{text}' AS transformation_applied, "
            f"{flag} AS leakage_risk_flag")

    for c in S.NUMERIC:
        source = dictionary.DERIVED_SOURCES.get(c, c)
        row(c, "float64", source, typed_rate(c),
            dictionary.NUMERIC_TEXTS.get(c, dictionary.DEFAULT_NUMERIC_TEXT), "FALSE")
        row(S.missing_flag(c), "int8", source, typed_rate(c),
            f"1 when {c} is missing or undefined before imputation", "FALSE")
    for c in S.ORDINALS:
        row(c, "int16", c, rate(c), dictionary.ORDINAL_TEXT, "FALSE")
    for name, dtype, source, text in dictionary.METADATA_TEXTS:
        row(name, dtype, source, rate(source), text, "TRUE")
    for c in S.POST_ORIGINATION:
        row(c, "excluded", c, "CAST(NULL AS DOUBLE)", dictionary.EXCLUDED_TEXT, "TRUE")
    one_hot = " UNION ALL ".join(
        f"SELECT column_name || '_' || category, 'float64', column_name, "
        f"round({rate(c)}, 6), '{dictionary.ONE_HOT_TEXT}', FALSE "
        f"FROM vocab WHERE column_name = '{c}'" for c in S.CATEGORIES)
    return " UNION ALL ".join(rows) + " UNION ALL " + one_hot


@query("data_dictionary", _dictionary_sql())
def data_dictionary(x: Inputs) -> DataFrame:
    labelled = x.split(stored=True)
    vocabulary = features.fit_vocabulary(labelled.filter(F.col(S.SPLIT) == "train"))
    described = dictionary.data_dictionary(
        x.loans(), labelled, features.Preprocessor({}, vocabulary))
    return described.select(
        "feature_name", "dtype", "source_column", *rounded("null_rate"),
        "transformation_applied", "leakage_risk_flag")


@query("numeric_summary", _each(S.NUMERIC, """
SELECT '{c}' AS feature, count(*) AS row_count, count({c}) AS non_null_count,
  count(*) - count({c}) AS missing_count, count({c}) AS finite_count,
  CAST(0 AS BIGINT) AS non_finite_count, round(avg({c}), 4) AS mean,
  round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS minimum,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS maximum FROM typed"""))
def numeric_summary(x: Inputs) -> DataFrame:
    typed = materialise(x.typed().select("loan_id", *S.NUMERIC))
    counts = perturb.SUMMARY_FIELDS[:5]
    return perturb.numeric_summary(typed, S.NUMERIC).select(
        "feature", *counts, *rounded(*perturb.SUMMARY_FIELDS[5:], digits=4))


@query("cv_folds", """
SELECT CAST(f.fold AS BIGINT) AS fold,
  CASE WHEN b.block < f.fold THEN 'train' ELSE 'validation' END AS role, b.issue_quarter, b.loans
FROM (SELECT issue_quarter, loans,
    CASE WHEN q_index - 1 < (n % 4) * (n // 4 + 1) THEN (q_index - 1) // (n // 4 + 1)
      ELSE n % 4 + (q_index - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS block
  FROM (SELECT issue_quarter, loans, q_index, count(*) OVER () AS n FROM split_quarters
    WHERE dataset_split = 'train')) b
JOIN (SELECT unnest([1, 2, 3]) AS fold) f ON b.block <= f.fold""")
def cv_folds(x: Inputs) -> DataFrame:
    train = x.split(stored=True).filter(F.col(S.SPLIT) == "train")
    return splits.fold_table(train, 3).select(*longs("fold"), "role", S.QUARTER, "loans")


@query("split_windows", """
SELECT dataset_split, count(*) AS row_count, count(DISTINCT issue_quarter) AS quarters,
  min(issue_quarter) AS first_quarter, max(issue_quarter) AS last_quarter,
  strftime(min(issue_d), '%Y-%m-%d %H:%M:%S') AS issue_date_min,
  strftime(max(issue_d), '%Y-%m-%d %H:%M:%S') AS issue_date_max
FROM labelled GROUP BY dataset_split""")
def split_windows(x: Inputs) -> DataFrame:
    return splits.split_windows(x.split(stored=True)).select(
        S.SPLIT, "row_count", "quarters", "first_quarter", "last_quarter",
        text_time("issue_date_min"), text_time("issue_date_max"))


@query("split_order", """
SELECT strftime(train_end, '%Y-%m-%d %H:%M:%S') AS train_end,
  strftime(validation_start, '%Y-%m-%d %H:%M:%S') AS validation_start,
  strftime(validation_end, '%Y-%m-%d %H:%M:%S') AS validation_end,
  strftime(shift_start, '%Y-%m-%d %H:%M:%S') AS shift_start,
  train_end < validation_start AND validation_end < shift_start AS chronological
FROM (SELECT max(issue_d) FILTER (dataset_split = 'train') AS train_end,
  min(issue_d) FILTER (dataset_split = 'validation') AS validation_start,
  max(issue_d) FILTER (dataset_split = 'validation') AS validation_end,
  min(issue_d) FILTER (dataset_split = 'shift') AS shift_start FROM labelled)""")
def split_order(x: Inputs) -> DataFrame:
    edges = ("train_end", "validation_start", "validation_end", "shift_start")
    return splits.split_order(x.split(stored=True)).select(
        *[text_time(e) for e in edges], "chronological")


@query("union_splits", """
SELECT dataset_split, count(*) AS loans, CAST(sum(loan_id) AS BIGINT) AS id_sum
FROM labelled GROUP BY dataset_split""")
def union_splits(x: Inputs) -> DataFrame:
    labelled = x.split(stored=True)
    parts = [labelled.filter(F.col(S.SPLIT) == s) for s in S.SPLITS]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(S.SPLIT).agg(
        F.count(F.lit(1)).alias("loans"), F.sum("loan_id").alias("id_sum"))


@query("store_contract", """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS bad_target, CAST(0 AS BIGINT) AS bad_date,
  CAST(0 AS BIGINT) AS bad_feature, CAST(0 AS BIGINT) AS bad_quarter,
  count(*) FILTER (dataset_split = 'train') AS train_rows,
  count(*) FILTER (dataset_split = 'validation') AS validation_rows,
  count(*) FILTER (dataset_split = 'shift') AS shift_rows, CAST(0 AS BIGINT) AS bad_split
FROM labelled""")
def store_contract(x: Inputs) -> DataFrame:
    unscaled, _, _ = x.views()
    return store.contract_counts(unscaled)


@query("store_manifest", """
SELECT 'quarter_rows' AS section, issue_quarter AS key, count(*) AS value
FROM labelled GROUP BY issue_quarter
UNION ALL SELECT 'split_rows', dataset_split, count(*) FROM labelled GROUP BY dataset_split
UNION ALL SELECT 'split_quarters', dataset_split, count(DISTINCT issue_quarter)
FROM labelled GROUP BY dataset_split
UNION ALL SELECT 'total_rows', 'all', count(*) FROM labelled""")
def store_manifest(x: Inputs) -> DataFrame:
    return store.manifest_counts(x.split())


@query("store_read", """
SELECT loan_id, issue_quarter, dataset_split, CAST(target AS BIGINT) AS target,
  strftime(issue_d, '%Y-%m-%d %H:%M:%S') AS issue_d,
  round(coalesce(annual_inc, (SELECT annual_inc FROM medians)), 6) AS annual_inc
FROM labelled""")
def store_read(x: Inputs) -> DataFrame:
    root = x.written_store()
    columns = ["loan_id", S.QUARTER, S.SPLIT, S.TARGET, S.ISSUE_DATE, "annual_inc"]
    ordered = store.read_store(x.spark, root, "unscaled", columns, ordered=True)
    return ordered.select("loan_id", S.QUARTER, S.SPLIT, *longs_of_target(),
                          text_time(S.ISSUE_DATE), *rounded("annual_inc"))


@query("store_roundtrip", """
SELECT CAST(0 AS BIGINT) AS differing_rows, count(*) AS manifest_rows,
  count(DISTINCT issue_quarter) AS partitions,
  34 + (SELECT count(*) FROM vocab) AS features FROM labelled""")
def store_roundtrip(x: Inputs) -> DataFrame:
    """Rows that differ between a written store and what was written: none, so the
    summary row reports counts per side."""
    labelled, preprocessor = x.fitted()
    root = scratch(x.spark, "store")
    manifest = store.write_store(labelled, preprocessor, root, raw=x.loans())
    written = store.read_store(x.spark, root)
    expected = preprocessor.transform(labelled)
    changed = store.content_difference(expected, written.select(*expected.columns))
    return changed.agg(
        F.count(F.lit(1)).alias("differing_rows"),
        F.lit(manifest["total_rows"]).cast("long").alias("manifest_rows"),
        F.lit(len(manifest["partitions"])).cast("long").alias("partitions"),
        F.lit(len(manifest["feature_names"])).cast("long").alias("features"),
    )


@query("store_validation", """
SELECT count(DISTINCT issue_quarter) AS partitions, min(issue_quarter) AS minimum_issue_quarter,
  max(issue_quarter) AS maximum_issue_quarter, count(*) AS total_rows,
  CAST(sum(target) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS quarters_crossing,
  count(*) FILTER (dataset_split = 'train') AS train_rows,
  count(*) FILTER (dataset_split = 'validation') AS validation_rows,
  count(*) FILTER (dataset_split = 'shift') AS shift_rows,
  (SELECT round(max(abs(m)), 6) FROM (SELECT avg(scaled) AS m FROM scaled
    WHERE dataset_split = 'train' GROUP BY feature)) AS max_abs_scaled_train_mean
FROM labelled""")
def store_validation(x: Inputs) -> DataFrame:
    _, scaled, _ = x.views()
    facts = store.store_validation(scaled)
    return facts.select(
        *[c for c in facts.columns if c != "max_abs_scaled_train_mean"],
        *rounded("max_abs_scaled_train_mean"))


@query("views_agree", """
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unmatched, CAST(0 AS BIGINT) AS issue_d_mismatches,
  CAST(0 AS BIGINT) AS issue_quarter_mismatches, CAST(0 AS BIGINT) AS dataset_split_mismatches,
  CAST(0 AS BIGINT) AS target_mismatches FROM labelled""")
def views_agree(x: Inputs) -> DataFrame:
    unscaled, scaled, _ = x.views()
    return store.views_agree(unscaled, scaled)


@query("store_diff", """
SELECT side, count(*) AS differing_rows, CAST(sum(loan_id) AS BIGINT) AS id_sum FROM (
  SELECT 'left_only' AS side, loan_id FROM labelled WHERE grade < 0 OR emp_length = 0
  UNION ALL SELECT 'right_only', loan_id FROM labelled WHERE grade >= 0 AND emp_length = 0) d
GROUP BY side""")
def store_diff(x: Inputs) -> DataFrame:
    """Difference between a view and a copy that lacks loans of unknown grade and
    states another income for new employees."""
    unscaled, _, _ = x.views()
    return store.content_difference(unscaled, _altered(unscaled)).groupBy("side").agg(
        F.sum("copies").alias("differing_rows"),
        F.sum(F.col("loan_id") * F.col("copies")).alias("id_sum"))


def _altered(unscaled: DataFrame) -> DataFrame:
    return unscaled.filter("grade >= 0").withColumn(
        "annual_inc",
        F.when((F.col("emp_length") == 0) & (F.col(S.missing_flag("emp_length")) == 0),
               F.col("annual_inc") + 1).otherwise(F.col("annual_inc")))


@query("quarter_digests", """
SELECT issue_quarter, count(*) AS left_rows, count(*) FILTER (grade >= 0) AS right_rows,
  NOT bool_or(grade < 0 OR coalesce(emp_length = 0, false)) AS same_rows
FROM labelled GROUP BY issue_quarter""")
def quarter_digests(x: Inputs) -> DataFrame:
    """The views of ``store_diff`` by digests: which quarters differ, without their rows."""
    unscaled, _, _ = x.views()
    sides = [
        evidence.content_digests(view, S.QUARTER).select(
            S.QUARTER, F.col("rows").alias(f"{side}_rows"), F.col("digest").alias(side))
        for side, view in (("left", unscaled), ("right", _altered(unscaled)))
    ]
    both = sides[0].join(sides[1], S.QUARTER, "full_outer")
    return both.select(
        S.QUARTER, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_rows", "right_rows")],
        F.col("left").eqNullSafe(F.col("right")).alias("same_rows"))


@query("file_zones", """
SELECT issue_quarter, count(*) AS rows, CAST(0 AS BIGINT) AS missing_times,
  strftime(min(issue_d), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(max(issue_d), '%Y-%m-%d %H:%M:%S') AS last_time
FROM labelled GROUP BY issue_quarter""")
def file_zones(x: Inputs) -> DataFrame:
    """The facts that a written store keeps of its files, by quarter."""
    facts = x.spark.read.parquet(f"{x.written_store()}/files/unscaled")
    return facts.groupBy(S.QUARTER).agg(
        F.sum("rows").alias("rows"), F.sum("missing_times").alias("missing_times"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
    ).select(S.QUARTER, "rows", "missing_times", text_time("first_time"), text_time("last_time"))


_WINDOW = TimeWindow("1998-02-01", "1999-07-01")


@query("window_slice", """
SELECT loan_id, issue_quarter, strftime(issue_d, '%Y-%m-%d %H:%M:%S') AS issue_d
FROM labelled WHERE issue_d >= TIMESTAMP '1998-02-01' AND issue_d < TIMESTAMP '1999-07-01'""")
def window_slice(x: Inputs) -> DataFrame:
    read = store.read_window(x.spark, x.written_store(), _WINDOW)
    return read.frame.select("loan_id", S.QUARTER, text_time(S.ISSUE_DATE))


@query("perturb_absolute", """
SELECT loan_id, round(CASE WHEN int_rate IS NULL THEN NULL
  ELSE greatest(least(int_rate + 5, 22.0), 0.0) END, 6) AS int_rate FROM typed""")
def perturb_absolute(x: Inputs) -> DataFrame:
    shift = perturb.Shift("int_rate", 5.0, lower=0.0, upper=22.0)
    return perturb.shift_all_rows(x.typed().select("loan_id", "int_rate"), shift).select(
        "loan_id", *rounded("int_rate"))


@query("perturb_relative", """
SELECT loan_id, round(least(dti * 1.1, 40.0), 6) AS dti FROM (
  SELECT loan_id, dti FROM typed WHERE dti IS NOT NULL)
UNION ALL SELECT loan_id, NULL FROM typed WHERE dti IS NULL""")
def perturb_relative(x: Inputs) -> DataFrame:
    shift = perturb.Shift("dti", 0.1, mode="relative", upper=40.0)
    return perturb.shift_all_rows(x.typed().select("loan_id", "dti"), shift).select(
        "loan_id", *rounded("dti"))


@query("perturb_sampled", """
SELECT CAST(0 AS BIGINT) AS operation, 'int_rate' AS feature, count(int_rate) AS eligible_rows,
  CAST(floor(count(int_rate) * 0.35 + 0.5) AS BIGINT) AS selected_rows,
  CAST(floor(count(int_rate) * 0.35 + 0.5) AS BIGINT) AS changed_rows FROM typed
UNION ALL SELECT 1, 'dti', count(dti), CAST(floor(count(dti) * 0.1 + 0.5) AS BIGINT),
  CAST(floor(count(dti) * 0.1 + 0.5) AS BIGINT) FROM (SELECT nullif(dti, 0) AS dti FROM typed)""")
def perturb_sampled(x: Inputs) -> DataFrame:
    """Exact-size seeded samples: eligible, selected and changed rows per shift."""
    rows = materialise(x.typed().select(
        "loan_id", "int_rate", F.nullif("dti", F.lit(0.0)).alias("dti")))
    shifts = [perturb.Shift("int_rate", 2.0, fraction=0.35),
              perturb.Shift("dti", 0.2, mode="relative", fraction=0.1)]
    _, report = perturb.perturb_with_report(rows, shifts, seed=7)
    return report.select(*longs("operation"), "feature", "eligible_rows", "selected_rows",
                         "changed_rows")


def _report_sql() -> str:
    def part(prefix: str, value: str) -> str:
        return (
            f"count(*) AS {prefix}row_count, count({value}) AS {prefix}non_null_count, "
            f"round(avg({value}), 4) AS {prefix}mean, round(stddev_pop({value}), 4) AS {prefix}std, "
            f"round(min({value}), 4) AS {prefix}minimum, round(median({value}), 4) AS {prefix}median, "
            f"round(max({value}), 4) AS {prefix}maximum")

    return f"""
SELECT 'int_rate' AS feature, count(int_rate) AS eligible_rows, count(int_rate) AS selected_rows,
  count(*) FILTER (int_rate <> shifted) AS changed_rows,
  {part('before_', 'int_rate')}, {part('after_', 'shifted')}
FROM (SELECT int_rate, CASE WHEN int_rate IS NOT NULL THEN least(int_rate + 5, 22.0) END AS shifted
  FROM typed)"""


@query("perturb_report", _report_sql())
def perturb_report(x: Inputs) -> DataFrame:
    rows = materialise(x.typed().select("loan_id", "int_rate"))
    _, report = perturb.perturb_with_report(
        rows, [perturb.Shift("int_rate", 5.0, upper=22.0)])
    columns = ["feature", "eligible_rows", "selected_rows", "changed_rows"]
    doubles = []
    for prefix in ("before_", "after_"):
        columns += [f"{prefix}row_count", f"{prefix}non_null_count"]
        doubles += [f"{prefix}{f}" for f in ("mean", "std", "minimum", "median", "maximum")]
    return report.select(*columns, *rounded(*doubles, digits=4))


@query("drift_simulation", """
SELECT issue_quarter, count(*) AS loans,
  round(avg(coalesce(dti, (SELECT dti FROM medians)) * 1.15), 6) AS dti FROM labelled
WHERE issue_d >= TIMESTAMP '1998-02-01' AND issue_d < TIMESTAMP '1999-07-01'
GROUP BY issue_quarter""")
def drift_simulation(x: Inputs) -> DataFrame:
    """Window read, seeded shifts and manifest over a written store."""
    from ledgerlens.jobs import simulate

    root = x.written_store()
    result = simulate.simulate(
        x.spark, root, window=_WINDOW,
        shifts=[perturb.Shift("int_rate", 3.0, fraction=0.5),
                perturb.Shift("dti", 0.15, mode="relative")],
        seed=20260926,
    )
    out = scratch(x.spark, "simulated")
    result.write(out)
    return x.spark.read.parquet(out).groupBy(S.QUARTER).agg(
        F.count(F.lit(1)).alias("loans"), F.avg("dti").alias("dti")
    ).select(S.QUARTER, "loans", *rounded("dti"))


# Stored pieces from which one file of a fixed number is written.
_PIECES = 8


def _csv_loans(x: Inputs, name: str, files: int | None = None) -> list[str]:
    """The loans as headed CSV files in the shared folder: as many as the rows have
    partitions, or a fixed number. One task writes a file; where their number is fixed, its
    rows come from stored columns, which are narrower than shuffled texts."""
    root = scratch(x.spark, name)
    rows = x.loans().withColumn("recoveries", F.lit("0"))

    def write(part: DataFrame, folder: str) -> None:
        part.write.option("header", True).option("quoteAll", True).csv(f"{root}/{folder}")

    if files is None:
        write(rows, "0")
    else:
        pieces = sorted(materialise(rows.repartition(files * _PIECES), name).inputFiles())
        dealt = [[loans.as_path(p) for p in pieces[k::files]] for k in range(files)]
        with ThreadPoolExecutor(files) as pool:
            list(pool.map(lambda k: write(
                x.spark.read.schema(rows.schema).parquet(*dealt[k]).coalesce(1), str(k)),
                [k for k in range(files) if dealt[k]]))
    names = x.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
        "recursiveFileLookup", True).load(root)
    return [r["path"] for r in names.select("path").orderBy("path").collect()]


@query("scan_loans", """
SELECT CASE WHEN issue_d IS NULL THEN 'none' ELSE substr(issue_d, 5, 4) END AS issue_year,
  count(*) AS loans,
  count(annual_inc) - count(*) FILTER (annual_inc = '') AS with_income,
  count(*) FILTER (loan_status = 'Current') AS current_loans FROM loans_raw GROUP BY 1""")
def scan_loans(x: Inputs) -> DataFrame:
    scanned = loans.allowed_loans(x.spark, _csv_loans(x, "csv"), keep=("loan_id",))
    return scanned.groupBy(
        F.coalesce(F.substring("issue_d", 5, 4), F.lit("none")).alias("issue_year")
    ).agg(
        F.count(F.lit(1)).alias("loans"), F.count("annual_inc").alias("with_income"),
        F.count_if(F.col("loan_status") == "Current").alias("current_loans"))


@query("source_inventory", """
SELECT CAST(4 AS BIGINT) AS files, count(*) AS rows_read, CAST(4 AS BIGINT) AS digests,
  CAST(20 AS BIGINT) AS columns_loaded, 'recoveries' AS ignored_columns FROM loans_raw""")
def source_inventory(x: Inputs) -> DataFrame:
    """Inventory of the loans written as four CSV files, summed up."""
    listed = loans.source_inventory(x.spark, _csv_loans(x, "inventory", files=4))
    return listed.groupBy("ignored_columns").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows_read").alias("rows_read"),
        F.count_distinct("sha256").alias("digests"),
        F.max("columns_loaded").cast("long").alias("columns_loaded"),
    )


@query("file_inventory")
def file_inventory(x: Inputs) -> DataFrame:
    return inventory.inventory_digest(inventory.files(x.spark, x.sf_dir, "*.parquet"))


@query("cohort_read", """
SELECT 'csv' AS source, count(*) AS loans, round(sum(dti), 4) AS dti FROM typed
UNION ALL SELECT 'json', count(*), round(sum(dti), 4) FROM typed""")
def cohort_read(x: Inputs) -> DataFrame:
    cohort = x.typed().select("loan_id", "dti", "int_rate")
    schema = "loan_id bigint, dti double, int_rate double"
    csv_root, json_root = scratch(x.spark, "cohort"), scratch(x.spark, "cohort") + ".json"
    cohort.write.option("header", True).csv(csv_root)
    cohort.write.json(json_root)
    csv_rows = loans.read_cohort(x.spark, csv_root, schema=schema)
    json_rows = x.spark.read.schema(schema).option("mode", "FAILFAST").json(json_root)
    both = csv_rows.withColumn("source", F.lit("csv")).unionByName(
        json_rows.withColumn("source", F.lit("json")))
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("dti").alias("dti")
    ).select("source", "loans", *rounded("dti", digits=4))


@query("acquisition_audit", """
SELECT 'region.parquet' AS source_id, 'archive: size mismatch' AS problem
UNION ALL SELECT 'nation.parquet', 'duplicate source_id'""")
def acquisition_audit(x: Inputs) -> DataFrame:
    """Audit of the given tables' files against a manifest derived from them, with
    one wrong size and one duplicate id to be found."""
    listed = inventory.files(x.spark, x.sf_dir, "*.parquet")
    wrong = F.when(F.col("name") == "region.parquet", F.col("bytes") + 1).otherwise(F.col("bytes"))
    values = {
        "role": F.lit("table"), "canonical_url": F.lit(""),
        "source_reported_version": F.lit("1"),
        "acquisition_completed_utc": F.lit("2024-01-01T00:00:00Z"),
        "archive_filename": F.col("name"), "archive_size_bytes": wrong.cast("string"),
        "archive_sha256": F.col("sha256"), "pipeline_input_filename": F.col("name"),
        "pipeline_input_size_bytes": F.col("bytes").cast("string"),
        "pipeline_input_sha256": F.upper("sha256"), "declared_license": F.lit("none"),
        "status": F.lit("acquired_verified"),
    }
    source = F.when(F.col("name") == "part.parquet", "nation.parquet").otherwise(F.col("name"))
    manifest = listed.select(
        source.alias("source_id"), *[v.alias(k) for k, v in values.items()])
    return inventory.acquisition_audit(manifest, listed)


@query("text_structure_check", """
SELECT CAST(quality AS VARCHAR) AS label, count(*) AS rows, CAST(4 AS BIGINT) AS min_width,
  CAST(4 AS BIGINT) AS max_width, count(*) FILTER (toxic = 1) AS missing_fields
FROM labels GROUP BY quality""")
def text_structure_check(x: Inputs) -> DataFrame:
    """The labels table as whitespace-separated text with unknowns as ``?``."""
    labels = x.table("labels")
    root = scratch(x.spark, "text")
    labels.select(F.concat_ws(
        "  ", F.lit("row"), F.col("doc_id").cast("string"),
        F.when(F.col("toxic") == 1, "?").otherwise("0"), F.col("quality").cast("string"),
    ).alias("value")).write.text(root)
    return inventory.text_structure(x.spark.read.text(root)).select(
        "label", "rows", *longs("min_width", "max_width", "missing_fields"))


@query("export_tables", _each(
    ("users", "applications", "predictions", "feedback", "audit_events"),
    "SELECT '{c}' AS table_name, count(*) AS rows FROM {c}"))
def export_tables(x: Inputs) -> DataFrame:
    root = scratch(x.spark, "export")
    names = ("users", "applications", "predictions", "feedback", "audit_events")
    inventory.export_tables({n: x.view(n) for n in names}, root)
    parts = [
        x.spark.read.text(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(n).alias("table_name"), "rows")
        for n in names
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
