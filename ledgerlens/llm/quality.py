"""Quality rules by document and by host, in built-in expressions only.

Every text is measured once, and only the small measures are kept. Rule failures are summed
by host; each host's failure rate is shrunk towards a beta prior fitted to all hosts (method of
moments), so that a host with few documents is not judged by them alone. A host whose shrunk
rate passes the limit for any rule is rejected, and its verdict is joined back to its
documents.

Cases: null and empty texts have no words and fail the word count; a null host gets no host
verdict; ties need no order, as all results are counts; repeated rows are separate documents
with equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import words
from ledgerlens.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Host rules: share of symbols per word, and of repeated lines per line with a word.
MOST_SYMBOLS = 0.5
MOST_DUP_LINES = 0.5
#: A host is rejected when its shrunk failure rate for a rule is above this.
HOST_LIMIT = 0.6
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
RULES = ("short", "repeats", "symbols", "lines")


def repeated_words(window_hashes: Column, repeated: Column) -> Column:
    """Words covered by windows whose hash occurs twice, given if any does."""
    placed = F.sort_array(F.transform(
        window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(
            F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    # One-element arrays bind a value once for all uses inside the lambda.
    places = F.get(F.transform(F.array(placed), flagged), F.lit(0))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    covered = F.aggregate(places, start, lambda acc, p: F.struct(
        (acc["words"] + p + WINDOW - F.greatest(p, acc["end"])).cast("int").alias("words"),
        (p + WINDOW).cast("int").alias("end")), lambda acc: acc["words"])
    return F.when(repeated, covered).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), F.col(host_col).alias("host"), text.alias("t"),
                        words(F.col(text_col)).alias("w"))
    lined = split.select(
        id_col, "host", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("w") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(F.col("w"), i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("h"))
    ordered = lined.select("*", F.sort_array("h").alias("s"))
    seen = ordered.select(
        "*", F.exists(F.transform("s", lambda x, k: x == F.get(F.col("s"), k + 1)),
                      lambda same: F.coalesce(same, F.lit(False))).alias("repeated"))
    return seen.select(
        id_col, "host", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h"), F.col("repeated")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
        "symbols": F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"),
        "lines": F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }


@dataclass(frozen=True)
class Prior:
    alpha: float
    weight: float


def fit_priors(hosts: DataFrame) -> dict[str, Prior]:
    """A beta prior per rule from the hosts' rates: one row of moments."""
    moments = hosts.agg(*[x for r in RULES for x in (
        F.avg(F.col(f"fail_{r}") / F.col("n")).alias(f"mean_{r}"),
        F.var_pop(F.col(f"fail_{r}") / F.col("n")).alias(f"var_{r}"))]).first()
    priors = {}
    for r in RULES:
        mean, var = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else PRIOR_WEIGHT[1]
        weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
        priors[r] = Prior(mean * weight, weight)
    return priors


def judge_hosts(measures: DataFrame) -> DataFrame:
    """(host, n, rate_<rule>..., host_failed) with shrunk failure rates."""
    hosts = measures.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.count_if(failed).alias(f"fail_{r}") for r, failed in _failures().items()])
    priors = fit_priors(hosts)
    rated = hosts.select("host", "n", *[
        ((F.col(f"fail_{r}") + priors[r].alpha) / (F.col("n") + priors[r].weight))
        .alias(f"rate_{r}") for r in RULES])
    return rated.withColumn("host_failed", F.greatest(
        *[F.col(f"rate_{r}") for r in RULES]) > HOST_LIMIT)


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                host_col: str = "source") -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``."""
    measures = materialise(
        measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), "measures")
    hosts = judge_hosts(measures).select("host", "host_failed")
    joined = measures.join(hosts, "host", "left")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~host_failed).alias("kept"))
