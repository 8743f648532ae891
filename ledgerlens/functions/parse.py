"""Text-to-value column expressions for raw loan fields.

Every parser has two layers. :func:`present` strips a field and nulls missing
tokens; the ``*_from`` functions read such text. Callers that parse many columns
project the texts first, so Spark evaluates each cleaning once instead of copying
it into every branch that mentions it. The ``parse_*`` functions do both at once.

Parsers return null both for missing and for unparsable text; :func:`unparsable`
tells the two apart so that a job can count bad values in one aggregate and raise
with examples. All reading is guarded ``try_cast``: no formatter exceptions, and
nothing leaves code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import schema as S

WHITESPACE = " \t\n\r\f\v"
# Only these characters; ``translate`` would make a text of every character it looks at.
NUMBER_SHAPE = r"\A[0-9+\-.eE]*\z"
MONTH_NUMBERS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
ISO_SHAPE = (
    r"^\d{4}(-\d{1,2}-\d{1,2}|/\d{1,2}/\d{1,2}|"
    r"-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2})$"
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_column(value).cast("string"), F.lit(WHITESPACE))


def file_nulls(value: Column | str) -> Column:
    """Null out the tokens that mean "no value" in a file."""
    column = as_column(value)
    return F.when(~column.isin(*S.FILE_NULLS), column)


def is_missing(value: Column | str) -> Column:
    text = strip(value)
    return text.isNull() | F.lower(text).isin(*S.MISSING_TEXT)


def present(value: Column | str) -> Column:
    """Stripped text, null when missing."""
    return present_of(strip(value))


def present_of(stripped: Column | str) -> Column:
    text = as_column(stripped)
    return F.when(~F.lower(text).isin(*S.MISSING_TEXT), text)


def finite_or_null(value: Column | str) -> Column:
    """NaN and both infinities become null."""
    column = as_column(value)
    return F.when(
        ~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column
    )


def plain_number(text: Column) -> Column:
    """A number spelled with digits, signs, point and exponent only. The cast alone
    would also take ``12d``, ``Infinity`` or ``nan``. May overflow to infinity."""
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def without_money_signs(text: Column | str) -> Column:
    """Stripped text without money signs; only texts that hold some are stripped again."""
    column = as_column(text)
    signs = F.contains(column, F.lit(",")) | F.contains(column, F.lit("$"))
    return F.when(signs, strip(F.translate(column, ",$", ""))).otherwise(column)


def number_from(text: Column | str) -> Column:
    return plain_number(without_money_signs(text))


def percent_from(text: Column | str) -> Column:
    """One trailing percent sign is dropped."""
    bare = without_money_signs(text)
    shorter = strip(F.substring(bare, F.lit(1), F.length(bare) - 1))
    return F.when(F.endswith(bare, F.lit("%")), plain_number(shorter)).otherwise(
        plain_number(bare)
    )


def term_from(text: Column | str) -> Column:
    months = F.regexp_extract(
        without_money_signs(text), r"^([0-9]+(?:\.0+)?)\s*(?:months?)?$", 1
    )
    return F.when(months != "", months.try_cast("double"))


def emp_length_text(text: Column | str) -> Column:
    """Lower-cased with single spaces: what :func:`emp_length_from` reads."""
    return F.regexp_replace(F.lower(without_money_signs(text)), r"\s+", " ")


def emp_length_from(normalised: Column | str) -> Column:
    text = as_column(normalised)
    years = F.regexp_extract(text, r"^([0-9]+(?:\.0+)?)\+?\s*years?$", 1)
    return (
        F.when(text.rlike(r"^(?:<|less than)\s*1\s*year$"), F.lit(0.0))
        .when(years != "", years.try_cast("double"))
        .otherwise(plain_number(text))
    )


def date_from(text: Column | str) -> Column:
    """``Mon-YYYY``, ``Mon-YY``, ISO or slashed dates, ISO date-times.

    Two-digit years follow the POSIX pivot: 69-99 are 19xx, 00-68 are 20xx. Only
    whole shapes are read, and the cast rejects days that do not exist.
    """
    column = as_column(text)
    month = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair]),
        F.lower(F.substring(column, 1, 3)),
    )
    digits = F.substring(column, 5, 4)
    century = F.when(F.length(column) == 8, F.lit("")).when(
        digits >= "69", F.lit("19")).otherwise(F.lit("20"))
    by_month = F.length(column).isin(6, 8) & (F.substring(column, 4, 1) == "-")
    return F.when(
        by_month, F.concat(century, digits, F.lit("-"), month, F.lit("-01")).try_cast("timestamp")
    ).when(column.rlike(ISO_SHAPE), F.translate(column, "/T", "- ").try_cast("timestamp"))


def parse_number(value: Column | str) -> Column:
    return finite_or_null(number_from(present(value)))


def parse_percent(value: Column | str) -> Column:
    return finite_or_null(percent_from(present(value)))


def parse_term(value: Column | str) -> Column:
    return term_from(present(value))


def parse_emp_length(value: Column | str) -> Column:
    return finite_or_null(emp_length_from(emp_length_text(present(value))))


def parse_date(value: Column | str) -> Column:
    return date_from(present(value))


def unparsable(value: Column | str, parser: Callable[[Column | str], Column]) -> Column:
    """True where text is present but ``parser`` cannot read it."""
    return present(value).isNotNull() & parser(value).isNull()


def category_from(text: Column | str, column: str) -> Column:
    case = {"purpose": F.lower, "home_ownership": F.upper}.get(column)
    shown = as_column(text)
    if case is not None:
        shown = F.regexp_replace(case(shown), r"\s+", "_")
    return F.coalesce(shown, F.lit(S.MISSING_CATEGORY))


def normalise_category(value: Column | str, column: str) -> Column:
    return category_from(present(value), column)


def grade_ordinal(value: Column | str) -> Column:
    text = F.upper(strip(value))
    return F.when(
        text.rlike(f"^[{S.GRADES}]$"), F.ascii(text) - F.lit(ord("A"))
    ).otherwise(F.lit(S.UNKNOWN_ORDINAL)).cast("short")


def sub_grade_ordinal(value: Column | str) -> Column:
    text = F.upper(strip(value))
    step = (F.ascii(text) - F.lit(ord("A"))) * S.SUB_GRADE_STEPS
    return F.when(
        text.rlike(f"^[{S.GRADES}][1-{S.SUB_GRADE_STEPS}]$"),
        step + F.ascii(F.substring(text, 2, 1)) - F.lit(ord("1")),
    ).otherwise(F.lit(S.UNKNOWN_ORDINAL)).cast("short")


PARSERS: dict[str, Callable[[Column | str], Column]] = {
    **{name: parse_number for name in S.MONEY_AND_COUNTS},
    **{name: parse_percent for name in S.PERCENTS},
    "term": parse_term,
    "emp_length": parse_emp_length,
}
# The second layer alone, for columns that hold present text already. Employment
# length is read from its normalised text.
READERS: dict[str, Callable[[Column | str], Column]] = {
    **{name: number_from for name in S.MONEY_AND_COUNTS},
    **{name: percent_from for name in S.PERCENTS},
    "term": term_from,
    "emp_length": emp_length_from,
}
