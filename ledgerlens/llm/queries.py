"""Registered queries of the text operators: thin selections over each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    align, bpe, chat, decontaminate, exact, html, jaccard, langid, merkle, pii, quality, repeats,
    tokens)
from ledgerlens.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return register


def tokenizer_file(name: str) -> str:
    from public_tokenizers import path

    return path(name)


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    path = tokenizer_file("byte_bpe_50k.json")
    documents = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(documents, path, decoded=True), path)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op10_pii_spans")
def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("op1_quality_rules", f"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i, w FROM split
  WHERE len(w) >= {quality.WINDOW}),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g FROM grams),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, s.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
f AS (
  SELECT *, n_words < {quality.LEAST_WORDS} AS short,
         100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS repeats,
         n_symbols > {quality.MOST_SYMBOLS} * n_words AS symbols,
         n_dup_lines > {quality.MOST_DUP_LINES} * n_lines AS lines FROM m),
hosts AS (
  SELECT source, r.rule, count(*) AS n, count(*) FILTER (r.failed) AS k
  FROM f, unnest([{{'rule': 'short', 'failed': short}}, {{'rule': 'repeats', 'failed': repeats}},
                  {{'rule': 'symbols', 'failed': symbols}}, {{'rule': 'lines', 'failed': lines}}]) u(r)
  WHERE source IS NOT NULL GROUP BY ALL),
moments AS (
  SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS var FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, mean, least(greatest(CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1
    ELSE {quality.PRIOR_WEIGHT[1]} END, {quality.PRIOR_WEIGHT[0]}), {quality.PRIOR_WEIGHT[1]}) AS weight
  FROM moments),
verdict AS (
  SELECT source, bool_or((k + mean * weight) / (n + weight) > {quality.HOST_LIMIT}) AS failed
  FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT coalesce(v.failed, false) AS kept
FROM f LEFT JOIN verdict v USING (source)
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition rules of every document, with its host's verdict."""
    return quality.apply_rules(table(spark, sf_dir, "documents"))


#: A conversation whose texts look like a template's own marks.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _escaped_sql(text: str) -> str:
    """SQL for the escaped form of a text: backslashes doubled, control strings broken."""
    sql = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return sql


@query("op7_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text)
                  FILTER (role = 'assistant'), '') AS loss,
         sum(length({_escaped_sql("text")}) + length(role)
             + {len(chat.TURN) + len(chat.END) + 2}) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256,
       length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM whole
""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every conversation, read back from its transcript."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    events = chat.from_messages(rows.unionByName(control))
    return chat.digests(chat.render(chat.fold(events)))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its place and the words that agree."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and best score of every document under a unigram vocabulary."""
    pieces = tokens.read_pieces(tokenizer_file("piece_bpe_32k.model"))
    return tokens.count(table(spark, sf_dir, "documents"), pieces)


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op4_repeated_bytes")
def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without strings that occur elsewhere."""
    return repeats.digests(repeats.remove(table(spark, sf_dir, "documents")))


@query("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document's text, and how many rows hold that text."""
    return exact.find(table(spark, sf_dir, "documents"))


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf_sql(text: str) -> str:
    values = [text if c == "text" else c for c in merkle.COLUMNS]
    return "sha256(" + " || ".join(map(_field_sql, values)) + ")"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE crc_bit AS (
  SELECT b, b AS c, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM crc_bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bit WHERE k = 8),
leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("text")} AS leaf,
         CASE WHEN (4294967295 - list_reduce(
             list_prepend(4294967295, list_transform(
               range(1, length(CAST(doc_id AS VARCHAR)) + 1),
               lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0
           THEN {_leaf_sql(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS changed
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS r FROM leaves),
tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY g, level, pos // 8, n),
subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT g, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1
         GROUP BY g, level, pos // 8),
upper_runs AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM upper WHERE n > 1
               GROUP BY level, pos // 8),
fold AS (
  SELECT r, g, 0 AS level, pos, coalesce(changed, leaf) AS h, '' AS sib FROM placed
  UNION ALL
  SELECT r, f.g, f.level + 1, pos // 8,
         sha256(array_to_string(hs[:pos % 8] || [h] || hs[pos % 8 + 2:], '')),
         sib || array_to_string(hs[:pos % 8] || hs[pos % 8 + 2:], '')
  FROM fold f JOIN runs u ON u.g = f.g AND u.level = f.level AND u.run = pos // 8),
lower_top AS (SELECT r, g, h, sib FROM fold QUALIFY level = max(level) OVER (PARTITION BY r)),
upper_fold AS (
  SELECT r, 0 AS level, s.pos, l.h, sib FROM lower_top l JOIN subroots s USING (g)
  UNION ALL
  SELECT r, f.level + 1, pos // 8,
         sha256(array_to_string(hs[:pos % 8] || [h] || hs[pos % 8 + 2:], '')),
         sib || array_to_string(hs[:pos % 8] || hs[pos % 8 + 2:], '')
  FROM upper_fold f JOIN upper_runs u ON u.level = f.level AND u.run = pos // 8),
top AS (SELECT r, h, sib FROM upper_fold QUALIFY level = max(level) OVER (PARTITION BY r))
SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(sib) AS proof_sha256,
       t.h AS folded_root, t.h = u.h AS verified
FROM placed p JOIN top t USING (r) JOIN subroots s USING (g), (SELECT h FROM upper WHERE n = 1) u
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every third one's text is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.prove(table(spark, sf_dir, "documents"), tampered=tampered)


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers end together in every document."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                       tokenizer_file("piece_bpe_32k.model"))
