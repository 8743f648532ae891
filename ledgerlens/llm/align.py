"""Alignment of two tokenizers' tokens over the same bytes, by an Arrow-native pipeline.

Every text is encoded by both tokenizers. A batch's tokens are two flat Arrow lists:

* list flatten and parent indices give each token its text; segmented cumulative sums of the
  tokens' byte lengths give its end in the text;
* text and end make one key, and an Acero hash join of both lists on it finds where tokens of
  both end together. These ends cut the text into groups;
* ``Table.group_by`` counts the linked pairs of ids, per text and per batch. Spark merges the
  batches' partial counts to counts of the corpus and brings them back to the texts.

Few pairs make up most links, and such a pair occurs in nearly every text. Pairs with at least
``HEAVY_SHARE`` of all links, of which there can be no more than its inverse, are broadcast;
the others are joined by shuffle.

Cases: a null or empty text has no tokens, nor has one whose tokens do not spell a blank and
the text (one that holds U+2581, say); special tokens' strings are ordinary text; repeated rows
give repeated results and count each time; ties for an id's best count all count; a very long
text is encoded whole, in a batch of its own; an empty table gives an empty result; other
columns are not carried along, so their names cannot clash.
"""

from __future__ import annotations

import copy
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import ByteBpe
from ledgerlens.llm.common import map_batches, texts_of
from ledgerlens.session import materialise

#: Characters that go through the Arrow pipeline at once.
CHUNK_CHARS = 1 << 20
#: Pairs from this share of all links are broadcast: at most as many as its inverse.
HEAVY_SHARE = 1 / 50_000
#: A key is the text's number in the chunk, then the end of a token in so many bits.
END_BITS = 40
#: A pair is the first tokenizer's id, then the second's in so many bits.
ID_BITS = 32

_FIGURES = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "pairs array<bigint>, times array<bigint>, batch_pairs array<bigint>, "
            "batch_times array<bigint>")
_NAMES = [part.split()[0] for part in _FIGURES.split(", ")]


class Tokens:
    """What a tokenizer's ids spell, as an Arrow array of byte strings by id."""

    def __init__(self, spelled: list[bytes | None]):
        self.bytes = pa.array(spelled, pa.binary())
        self.lengths = pc.fill_null(pc.binary_length(self.bytes), 0).cast(pa.int64())


class First:
    """A byte-level BPE file; special tokens' strings are ordinary text."""

    def __init__(self, source: str):
        self.bpe = copy.copy(ByteBpe(source))
        spelled = self.bpe.bytes
        self.tokens = Tokens([spelled.get(i) for i in range(max(spelled) + 1)])
        self.bpe.specials, self.bpe.allowed, self.bpe.margin = {}, set(), 4

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.bpe.encode(" " + t) for t in texts]


class Second:
    """A piece model with byte fallback, which begins every text with a blank."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        self.tokens = Tokens([
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.model.id_to_piece(list(range(size))))])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def _tokenizers(a: str, b: bytes) -> tuple[First, Second]:
    return First(a), Second(b)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((i for r in rows for i in r), np.int32, offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _spelled(ids: pa.ListArray, tokens: Tokens) -> pa.Array:
    """The bytes that each list of ids spells."""
    parts = pa.LargeListArray.from_arrays(
        ids.offsets.cast(pa.int64()), tokens.bytes.take(ids.values).cast(pa.large_binary()))
    return pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))


def _ends(ids: pa.ListArray, tokens: Tokens) -> tuple[pa.Array, pa.Array]:
    """(key, id) of every token: a cumulative sum of byte lengths, restarted at each text."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
    upto = pc.cumulative_sum(tokens.lengths.take(flat))
    starts = ids.offsets.slice(0, len(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(starts)
    end = pc.subtract(upto, before.take(parent))
    return pc.add(pc.shift_left(parent, END_BITS), end), flat


def _links(a: pa.ListArray, b: pa.ListArray, one: Tokens, two: Tokens) -> pa.Table:
    """Places and ids of the tokens that end together, in the order of the text."""
    sides = []
    for name, ids, tokens in (("a", a, one), ("b", b, two)):
        key, flat = _ends(ids, tokens)
        sides.append(pa.table({"key": key, name: flat.cast(pa.int64()),
                               f"{name}_at": pa.array(np.arange(len(flat)), pa.int64())}))
    return sides[0].join(sides[1], "key", join_type="inner", use_threads=False).sort_by("key")


def _groups(ids: pa.ListArray, last: pa.Array) -> pa.Array:
    """Ids between common ends, joined by commas; ``last`` are the groups' last tokens."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.add(last, 1)])
    texts = pc.list_flatten(ids).cast(pa.large_string())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts),
                          pa.scalar(",", pa.large_string()))


def _runs(sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.array(offsets)


def align_texts(texts: list[str], first: First, second: Second) -> tuple[dict, pa.Table]:
    """Figures by text as columns, and the partial counts of all the texts' linked pairs."""
    n = len(texts)
    a, b = _lists(first.encode(texts)), _lists(second.encode(texts))
    wanted = pa.array([(" " + t).encode("utf-8", "surrogatepass") for t in texts],
                      pa.large_binary())
    same = pc.and_(pc.equal(_spelled(a, first.tokens), wanted),
                   pc.equal(_spelled(b, second.tokens), wanted))
    whole = pc.and_(same, pc.greater(pc.binary_length(wanted), 1))
    kept = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    a, b = a.take(pa.array(kept)), b.take(pa.array(kept))

    links = _links(a, b, first.tokens, second.tokens).combine_chunks()
    text = pc.shift_right(links["key"], END_BITS).combine_chunks()
    per_text = np.bincount(text.to_numpy(), minlength=len(kept))
    joined = pc.binary_join_element_wise(
        _groups(a, links["a_at"].combine_chunks()), _groups(b, links["b_at"].combine_chunks()),
        pa.scalar("|", pa.large_string()))
    strings = pc.binary_join(pa.LargeListArray.from_arrays(_runs(per_text), joined),
                             pa.scalar(";", pa.large_string()))

    pair = pc.bit_wise_or(pc.shift_left(links["a"], ID_BITS), links["b"])
    counted = pa.table({"text": text, "pair": pair}).group_by(
        ["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    partial = counted.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
    distinct = np.bincount(counted["text"].to_numpy(), minlength=len(kept))

    def spread(values, empty: int = 0) -> np.ndarray:
        out = np.full(n, empty, np.int64)
        out[kept] = values
        return out

    digests = [""] * n
    for k, groups in zip(kept, strings.to_pylist()):
        digests[k] = hashlib.sha256(groups.encode()).hexdigest()
    runs = _runs(spread(distinct)).cast(pa.int32())
    figures = {
        "n_a": pa.array(spread(pc.list_value_length(a).to_numpy())),
        "n_b": pa.array(spread(pc.list_value_length(b).to_numpy())),
        "n_groups": pa.array(spread(per_text)), "n_links": pa.array(spread(per_text)),
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(runs, counted["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(runs, counted["count_all"].combine_chunks())}
    return figures, partial.rename_columns(["pair", "n"])


def _chunks(texts: list[str]):
    """Slices of rows of about ``CHUNK_CHARS`` characters; a longer text is one by itself."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > CHUNK_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def link(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(row, id, figures, pairs, times, batch_pairs, batch_times) for every row.

    ``first`` and ``second`` are the tokenizers' files on the driver; their content, of a few
    MB whatever the data, is sent to the tasks. ``pairs`` and ``times`` are the row's own
    linked pairs; the first row of a chunk also has the counts of the whole chunk."""
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        one, two = _tokenizers(*files.value)

        def work(batch: pa.RecordBatch):
            texts = texts_of(batch)
            for start, end in _chunks(texts):
                figures, partial = align_texts(texts[start:end], one, two)
                sizes = _runs(np.array([len(partial)] + [0] * (end - start - 1))).cast(pa.int32())
                for name, column in (("batch_pairs", "pair"), ("batch_times", "n")):
                    figures[name] = pa.ListArray.from_arrays(
                        sizes, partial[column].combine_chunks())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start)]
                    + [figures[c] for c in _NAMES], ["id", *_NAMES])

        return work

    linked = map_batches(rows, make, f"id {kind}, {_FIGURES}")
    # Written before it is read again, so a row's number stays its own.
    return materialise(linked.withColumn("row", F.monotonically_increasing_id()), "links")


def _flat(rows: DataFrame, pairs: str, times: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip(
        F.col(pairs).alias("pair"), F.col(times).alias("n"))).alias("x")).select(
            *keep, F.col("x.pair").alias("pair"), F.col("x.n").alias("n"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): how many links of the corpus hold each pair of ids, and
    whether no other pair of its second id holds more."""
    merged = _flat(linked, "batch_pairs", "batch_times").groupBy("pair").agg(
        F.sum("n").alias("count")).withColumn("b", F.expr(f"pair & {(1 << ID_BITS) - 1}"))
    merged = materialise(merged, "pairs")
    most = merged.groupBy("b").agg(F.max("count").alias("most"))
    return merged.join(most, "b").select(
        "pair", F.shiftright("pair", ID_BITS).alias("a"), "b", "count",
        (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Tokens, groups and links of every row, and how common its links are in the corpus."""
    linked = link(docs, first, second, id_col=id_col, text_col=text_col)
    counts = materialise(pair_counts(linked), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(1, int(total * HEAVY_SHARE) + 1)
    worth = counts.select("pair", F.col("count"), F.col("best").cast("long").alias("is_best"))
    # At most 1 / HEAVY_SHARE pairs can hold that share of all links, so they are broadcast.
    heavy = F.broadcast(worth.filter(F.col("count") >= least))
    light = worth.filter(F.col("count") < least)
    own = _flat(linked, "pairs", "times", "row")

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(
            F.sum(F.col("n") * F.col("is_best")).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    sums = summed(own.join(heavy, "pair")).unionByName(
        summed(own.join(heavy, "pair", "left_anti").join(light, "pair")))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"),
                                   F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.select("row", "id", *_NAMES[:5]).join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
