"""Language identification with bit-sliced n-gram filters.

Training counts character trigrams by language and keeps the most frequent of each, unless
another language uses a trigram so much more that its own count may come from foreign
passages and wrong labels. One Bloom filter per language holds them, stored bit-sliced: a row of the table has one bit per
language, so the bitwise AND of a trigram's rows names all languages that contain it at
once. A text's verdict counts, per language, the trigrams found, corrects each count for
the false positives of that language's slice, and takes the largest.

Cases: ``und`` with score 0 for a null text, a text without letters, or when nothing could
be learned; ties go to the language that sorts first; null languages are not learned from;
repeated rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, map_batches, texts_of

#: Labelled texts per language that training expects to use; the rest only get predictions.
FIT_DOCS = 3_000
#: Trigrams kept per language.
FIT_GRAMS = 2_500
#: A trigram belongs to a language if its rate there is at least this part of its highest rate.
OWN_RATE = 0.25
#: Rows of the filter table and hash functions.
TABLE_BITS = 17
HASHES = 3
#: Characters handled at once.
CHUNK = 1 << 20
UNKNOWN = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each between blanks, with non-letters as
    blanks; and where each text starts."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    starts = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    return np.where(_letters()[points], points, np.uint32(32)), starts


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for the trigram that starts at each place, and whether it counts: it must
    have a letter in the middle, so runs of blanks count once for neither side."""
    points = points.astype(np.uint64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    return (a << np.uint64(42)) | (b << np.uint64(21)) | c, b != 32


def _slots(grams: np.ndarray, k: int) -> np.ndarray:
    h = (grams ^ (grams >> np.uint64(29))) * _MIX[k]
    h = (h ^ (h >> np.uint64(32))) * _MIX[(k + 1) % 3]
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Filters:
    """The bit-sliced table; language ``k`` is bit ``k % 64`` of word ``k // 64``."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams_of: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams_of)
        table = np.zeros((max(1, math.ceil(len(languages) / 64)), 1 << TABLE_BITS), np.uint64)
        for k, name in enumerate(languages):
            for h in range(HASHES):
                np.bitwise_or.at(table[k // 64], _slots(grams_of[name], h),
                                 np.uint64(1 << (k % 64)))
        fill = np.array([((table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
                         for k in range(len(languages))])
        return cls(languages, table, fill ** HASHES)

    @classmethod
    def from_rates(cls, rates: dict[str, dict[int, float]]) -> Filters:
        """Filters of each language's own trigrams, from the rates of its frequent ones."""
        top: dict[int, float] = {}
        for grams in rates.values():
            for gram, rate in grams.items():
                top[gram] = max(rate, top.get(gram, 0.0))
        return cls.build({
            lang: np.array([g for g, rate in grams.items() if rate >= OWN_RATE * top[g]], np.uint64)
            for lang, grams in rates.items()})

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and how many of them each language's filter has."""
        points, starts = _codes(texts)
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        for lo in range(0, len(points) - 2, CHUNK):
            grams, counts = _grams(points[lo:lo + CHUNK + 2])
            at = np.flatnonzero(counts)
            grams = grams[at]
            owner = np.searchsorted(starts, at + lo + 1, "right") - 1
            total += np.bincount(owner, minlength=len(texts))
            slots = [_slots(grams, h) for h in range(HASHES)]
            for word in range(len(self.table)):
                mask = self.table[word][slots[0]]
                for s in slots[1:]:
                    mask &= self.table[word][s]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    has = (mask >> np.uint64(k % 64)) & np.uint64(1) == 1
                    hits[:, k] += np.bincount(owner[has], minlength=len(texts))
        return total, hits

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages or not texts:
            return [(UNKNOWN, 0.0)] * len(texts)
        total, hits = self.found(texts)
        share = hits / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = share.argmax(axis=1)
        return [(self.languages[b], float(share[n, b])) if total[n] else (UNKNOWN, 0.0)
                for n, b in enumerate(best)]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_grams: int = FIT_GRAMS) -> Filters:
    """Filters from labelled texts outside the evaluation fold.

    At most about ``fit_docs`` texts per language are used: where a language has more, those
    whose id hashes below the matching threshold. The driver gets ``fit_grams`` trigrams per
    language, whatever the size of the corpus."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r[lang_col]: r["n"] for r in labelled.groupBy(lang_col).agg(
        F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters.build({})
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (
        F.lit(lang), F.lit(math.ceil(1_000_000 * min(1.0, fit_docs / n))))])
    sample = labelled.filter(spread < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def make():
        def work(batch: pa.RecordBatch):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                points, _ = _codes(texts)
                for lo in range(0, len(points) - 2, CHUNK):
                    grams, counts = _grams(points[lo:lo + CHUNK + 2])
                    kinds, n = np.unique(grams[counts], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(kinds), pa.string()),
                         pa.array(kinds.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"])

        return work

    counted = map_batches(sample, make, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.groupBy("lang").agg(
        F.sum("n").alias("total"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "gram"))),
                1, fit_grams).alias("top"))
    return Filters.from_rates({
        r["lang"]: {x["gram"]: -x["order"] / r["total"] for x in r["top"]}
        for r in ranked.collect()})


def predict(docs: DataFrame, filters: Filters, *, text_col: str = "text",
            carry: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns, language and score for every row. The filters' size is set by
    parameters and the number of languages, not by the data."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    source = fresh(docs, "__text")
    kept = list(dict.fromkeys(carry))
    rows = docs.select(*kept, F.col(text_col).alias(source))

    def make():
        def work(batch: pa.RecordBatch):
            found = shared.value.predict(texts_of(batch, source))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept),
                 pa.array([x for x, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())],
                [*kept, *names])

        return work

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return map_batches(rows, make, ", ".join(
        [*shape, f"`{names[0]}` string", f"`{names[1]}` double"]))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): fit on the labelled part, predict every row."""
    filters = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = predict(docs, filters, text_col=text_col, carry=(id_col,))
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
