"""From raw documents to token ids: five stages, each written as Parquet for the next.

1. language ID: documents without a recognised language go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. decontamination: documents that hold a benchmark item go;
4. personal data is masked;
5. BPE: documents become token ids, checked by decoding them.

Stages 1 to 4 return the columns of ``documents``. Null texts have no language and go in
stage 1; an empty table stays empty throughout; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontaminate, jaccard, langid, pii
from ledgerlens.llm.common import fresh, table
from ledgerlens.session import materialise

#: A text counts as a language from this share of its trigrams in that language's filter.
LEAST_LANGUAGE_SCORE = 0.2
TOKENIZER = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    found = langid.predict(docs, langid.fit(docs), carry=tuple(docs.columns), names=(lang, score))
    known = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select(
        *[F.coalesce("lang", lang).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    if "n_chars" not in masked.columns:
        return masked
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(n, "n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    file = path(TOKENIZER)
    return bpe.digests(bpe.encode(docs, file, decoded=True), file, keep=("ids",))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", token_ids),
]

#: Near duplicates and language models cannot be stated in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
