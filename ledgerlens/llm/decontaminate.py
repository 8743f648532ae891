"""Benchmark decontamination by spaced seeds, in built-in expressions only.

A seed is a fixed mask over consecutive words: it compares some places and ignores the others.
An item of ``n`` words still counts after ``n // 5`` substitutions. Its words are cut into
``n // 5`` stretches of five, of which one at least then has no more than one change; the five
masks of a stretch each ignore one place and compare the other four, so one of them hits. Every
position of every document is looked up with the same masks.

Hits are summed by how an item would lie over a document. A stretch without a change is hit five
times, with one change once, so a placement that counts has ``n // 5`` hits, or five where only a
long stretch of it is there (see ``least_hits``); placements with fewer go unread. The rest are
compared word by word: the overlap counts if enough words agree in the item as a whole or in a
long stretch of it.

Words are taken as in the contracts, lower-cased in A-Z, and without the punctuation
around them.

Cases: null, empty and very short texts (under ``LEAST_WORDS`` words) neither match nor are
matched; several items in one document give a row each, repeated rows and equal items too;
of several placements of an item in a document the one with most equal words counts, then the
first; very long texts are looked up at every position, and only those with a placement are
compared whole; empty tables give an empty result; other columns are not read. A null id matches
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, held_by_size, words
from ledgerlens.session import materialise

#: An item counts from this share of equal words over its whole length ...
LEAST_SHARE = 0.8
#: ... or from so many words of which this share are equal, where only a part is there.
LEAST_STRETCH = 13
LEAST_WORDS = 5
#: Words of a stretch of an item; one of them may be changed.
SPAN = 5
#: Offsets that a mask compares, from its first one. Ignoring the first or the last place of a
#: stretch is one mask at two positions.
MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
#: (position in a stretch, mask): the five ways to ignore one place of it.
PLACES = ((1, 0), (0, 1), (0, 2), (0, 3), (0, 0))
#: Places of seeds that may be broadcast: about 32 bytes each, so at most 64 MB.
MOST_BROADCAST = 2_000_000

#: Punctuation that is ignored around a word.
EDGES = ".,;:!?\"'`()[]{}<>*#$%&|=+-/\\~_^@…“”„«»‘’"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order, ignoring case and punctuation around words."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(words(lower), lambda w: F.xxhash64(F.btrim(w, F.lit(EDGES))))


def seed(hashes: Column, at: Column, mask: int) -> Column:
    """The seed of a mask at a place of an array of word hashes."""
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + k) for k in MASKS[mask]])


def item_seeds(tests: DataFrame) -> DataFrame:
    """(item, pos, seed) of every mask on every stretch of every item."""
    stretches = tests.select("item", "h", F.explode(F.sequence(
        F.lit(0), F.floor(F.size("h") / SPAN).cast("int") - 1)).alias("k"))
    return stretches.select("item", F.inline(F.array(*[
        F.struct((F.col("k") * SPAN + at).alias("pos"),
                 seed(F.col("h"), F.col("k") * SPAN + at, mask).alias("seed"))
        for at, mask in PLACES])))


def least_hits(n_words: Column) -> Column:
    """Fewest hits of a placement that counts. As a whole: ``n // 5`` stretches with at most as
    many changes. In part: a stretch of ``LEAST_STRETCH`` + 5 c words with c changes holds c + 1
    whole stretches of five, and b of them with c changes are hit at least 5 b - 4 c times."""
    return F.least(F.floor(n_words / SPAN), F.lit(len(PLACES)))


def _seed_rows(hashed: DataFrame) -> DataFrame:
    """(id, key, pos, seed) for each place and mask. Places become rows first, so that seeds
    are computed by generated code, a few array reads each; the array itself is not copied.
    A seed that runs over the end has fewer words than its mask and equals no other."""
    places = hashed.filter(F.size("h") >= LEAST_WORDS).select(
        "id", "key", "h", F.explode(F.sequence(F.lit(0), F.size("h") - SPAN + 1)).alias("pos"))
    return places.select("id", "key", "pos", F.explode(F.array(*[
        seed(F.col("h"), F.col("pos"), m) for m in range(len(MASKS))])).alias("seed"))


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start, n_words, n_equal): documents that hold an item, and where.

    ``start`` is the place of the item's first word in the document; it is negative where
    the document begins inside the item."""
    return _find(docs, items, id_col, text_col, item_col, item_text).drop("key").withColumnsRenamed(
        {"id": id_col, "item": item_col})


def _find(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str,
          item_text: str) -> DataFrame:
    """(id, key, item, start, n_words, n_equal); ``key`` is a hash of the text."""
    spark = docs.sparkSession
    tests = materialise(items.select(
        F.col(item_col).alias("item"), word_hashes(F.coalesce(item_text, F.lit(""))).alias("h"))
        .filter(F.size("h") >= LEAST_WORDS), "items")
    # Equal items share their seeds; a seed names the items and places it comes from.
    wanted = materialise(item_seeds(tests).groupBy("seed").agg(
        F.collect_set(F.struct("item", "pos")).alias("of")), "seeds")
    n_seeds = wanted.agg(F.sum(F.size("of"))).first()[0] or 0
    needed = tests.groupBy("item").agg(F.min(least_hits(F.size("h"))).alias("needed"))
    n_items = tests.count()

    source = docs.select(F.col(id_col).alias("id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashed = source.select("id", F.xxhash64("t").alias("key"), word_hashes(F.col("t")).alias("h"))
    hits = (
        _seed_rows(hashed)
        .join(held_by_size(wanted, n_seeds, MOST_BROADCAST), "seed")
        .select("id", "key", "pos", F.explode("of").alias("o"))
        .select("id", "key", F.col("o.item").alias("item"),
                (F.col("pos") - F.col("o.pos")).alias("start"))
        .groupBy("id", "key", "item", "start").agg(F.count("*").alias("n_hits"))
        .join(held_by_size(needed, n_items, MOST_BROADCAST), "item")
        .filter(F.col("n_hits") >= F.col("needed")).drop("needed"))
    placed = materialise(hits, "hits")
    return _verify(spark, source, tests, placed)


def _verify(spark, source: DataFrame, tests: DataFrame, placed: DataFrame) -> DataFrame:
    """Compare words around each hit."""
    n_placed = placed.count()
    # Items have any length, so their words are counted, not their rows.
    n_words = tests.agg(F.sum(F.size("h"))).first()[0] or 0
    sides = placed.join(held_by_size(tests, n_words, MOST_BROADCAST), "item")
    # Word hashes are taken again only for the few documents with a hit.
    keys = placed.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).distinct()
    chosen = source.withColumn("key", F.xxhash64("t")).join(
        held_by_size(keys, n_placed, MOST_BROADCAST),
        F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")),
        "left_semi")
    texts = materialise(
        chosen.select("id", "key", word_hashes(F.col("t")).alias("d")), "texts")
    texts = texts.groupBy("id", "key").agg(F.first("d").alias("d"), F.count("*").alias("copies"))
    both = sides.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}).join(
        texts, F.col("hit_id").eqNullSafe(F.col("id")) & (F.col("hit_key") == F.col("key")))
    lined = both.select(
        "id", "key", "item", "start", "copies", F.size("h").alias("n_words"),
        F.zip_with("h", F.when(
            F.col("start") >= 0, F.slice("d", F.col("start") + 1, F.size("h"))
        ).otherwise(F.concat(
            F.array_repeat(F.lit(None).cast("bigint"), -F.col("start")),
            F.slice("d", 1, F.greatest(F.size("h") + F.col("start"), F.lit(0))))),
            lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")).alias("same"))
    total = F.aggregate("same", F.lit(0), lambda acc, x: acc + x)
    stretch = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    # Kadane's scan: the best stretch where an equal word scores 1 and another -4.
    best = F.aggregate("same", stretch, lambda acc, x: F.struct(
        F.greatest(acc["run"] + 5 * x - 4, F.lit(0)).alias("run"),
        F.greatest(acc["best"], acc["run"] + 5 * x - 4).alias("best")), lambda acc: acc["best"])
    judged = lined.select("id", "key", "item", "start", "copies", "n_words",
                          total.alias("n_equal"), best.alias("stretch"))
    ok = judged.filter((F.col("n_equal") >= LEAST_SHARE * F.col("n_words"))
                       | (F.col("stretch") >= LEAST_STRETCH))
    top = ok.groupBy("id", "key", "item").agg(F.max(F.struct(
        "n_equal", (-F.col("start")).alias("order"), "n_words", "copies")).alias("b"))
    return top.select("id", "key", "item", (-F.col("b.order")).cast("long").alias("start"),
                      F.col("b.n_words").cast("long").alias("n_words"),
                      F.col("b.n_equal").cast("long").alias("n_equal"),
                      F.explode(F.sequence(F.lit(1), F.col("b.copies").cast("int"))).alias("copy")
                      ).drop("copy")


def remove(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Rows go by id and text, so that
    of rows with one id, or without an id, only those that hold an item go."""
    name, key = fresh(docs, "__found"), fresh(docs, "__key")
    found = materialise(_find(docs, items, id_col, text_col, "item_id", "text").select(
        F.col("id").alias(name), F.col("key").alias(key)).distinct(), "found")
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(held_by_size(found, found.count(), MOST_BROADCAST),
                     F.col(id_col).eqNullSafe(F.col(name)) & (text_key == F.col(key)), "left_anti")
