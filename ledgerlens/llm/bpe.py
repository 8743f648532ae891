"""Byte-level BPE by tree concatenation.

Ordinary text is encoded piece by piece. A long text is cut at fixed places without
regard to its content, its parts are encoded in parallel tasks, and neighbouring parts
are joined pairwise up a tree. A join re-encodes only a window around the seam:

* the window reaches to the nearest place on either side where the pre-tokenizer always
  cuts whatever surrounds it, so tokens beyond it cannot change;
* where no such place is near (one unsplit run of letters, say), the window is grown token
  by token inside that run until its first and last token agree with those of the parts.
  Neighbouring tokens that merges leave apart stay apart, so agreement proves the join.

Cases: a null or empty text has no tokens and decodes to the empty text; special token
strings in a text become special tokens, as in the tokenizers library; repeated rows give
repeated results; other columns of the input are not carried along.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, texts_of

#: Code points of a part that one task encodes at once.
PART_CHARS = 32_768
#: Longest unsplit stretch given to the merge loop as one piece; longer ones are halved.
LEAF_CHARS = 2_048
#: Tokens on either side of a seam that the first window of a run takes.
FIRST_WINDOW = 8

# The pre-tokenizer's pattern and letters that every Unicode version has.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"

# The pre-tokenizer always cuts here: before white space, and between letters and digits.
CUT = re.compile(rf"(?<=[!-~])(?=[ \t\n\r])|(?<=[{LETTERS}])(?=[0-9 \n])|(?<=[0-9])(?=[{LETTERS}])")
LONG_RUN = re.compile(rf"[^ \t\n\r]{{{LEAF_CHARS},}}+")
ONE_PIECE = re.compile(rf" ?(?:[{LETTERS}]++|[0-9]++)")


@dataclass
class Node:
    """A text and its exact encoding."""

    text: str
    ids: list[int]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("the pre-tokenizer must split by its pattern and add no space")
        letters = _byte_letters()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()
                 if token not in specials}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        order = [model["vocab"][m.replace(" ", "", 1)] for m in merges]
        if any(a >= b for a, b in zip(order, order[1:])):
            raise ValueError("token ids must follow the order of the merges")
        self.specials = specials
        self.core = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.bytes = {i: b for b, i in ranks.items()}
        self.bytes |= {i: s.encode() for s, i in specials.items()}
        self.allowed = set(specials)
        self.margin = max([len(s) for s in specials], default=0) + 4

    def flat(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special=self.allowed, disallowed_special=())

    def encode(self, text: str) -> list[int]:
        """Ids of a text; only texts with a long unsplit stretch are taken apart."""
        if len(text) > LEAF_CHARS and LONG_RUN.search(text):
            return self.tree(text).ids
        return self.flat(text)

    def tree(self, text: str) -> Node:
        if len(text) <= LEAF_CHARS:
            return Node(text, self.flat(text))
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def join(self, left: Node, right: Node) -> Node:
        """The exact encoding of both texts together, from those of each."""
        start, end = self._left_cut(left.text), self._right_cut(right.text)
        head, tail = left.text[start:], right.text[:end]
        n_head, n_tail = len(head.encode()), len(tail.encode())
        a = self._count(reversed(left.ids), n_head)
        b = self._count(iter(right.ids), n_tail)
        keep, rest = left.ids[:len(left.ids) - a], right.ids[b:]
        seam = head + tail
        if len(seam) > LEAF_CHARS and ONE_PIECE.fullmatch(seam):
            middle = self._join_run(left.ids[len(left.ids) - a:], right.ids[:b])
        else:
            middle = self.flat(seam)
        return Node(left.text + right.text, keep + middle + rest)

    def _left_cut(self, text: str) -> int:
        """A place in ``text`` where a piece begins, whatever follows ``text``."""
        span = max(64, self.margin)
        while span < len(text):
            base = len(text) - span
            places = [m.start() for m in CUT.finditer(text, base, len(text) - self.margin)]
            places = [p for p in places if p > base and self._outside(text, p)]
            if places:
                return places[-1]
            span *= 2
        return 0

    def _right_cut(self, text: str) -> int:
        at = 0
        while m := CUT.search(text, at):
            if m.start() >= self.margin and self._outside(text, m.start()):
                return m.start()
            at = m.start() + 1
        return len(text)

    def _outside(self, text: str, place: int) -> bool:
        """Whether no special token's string covers the place."""
        return not any(
            0 <= text.find(s, max(0, place - len(s) + 1), place + len(s) - 1) < place
            for s in self.specials)

    def _count(self, ids, n_bytes: int) -> int:
        """How many ids make up so many bytes."""
        count = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes[next(ids)])
            count += 1
        if n_bytes:
            raise AssertionError("a window must end between tokens")
        return count

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one unsplit run from the tokens of its two halves."""
        i = j = FIRST_WINDOW
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            a, b = left[len(left) - i:], right[:j]
            window = self.core._encode_single_piece(b"".join(self.bytes[t] for t in a + b))
            ok_left = i == len(left) or window[0] == a[0]
            ok_right = j == len(right) or window[-1] == b[-1]
            if ok_left and ok_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = (i if ok_left else 2 * i), (j if ok_right else 2 * j)

    def join_all(self, nodes: list[Node]) -> Node:
        """Join neighbours pairwise until one is left."""
        while len(nodes) > 1:
            paired = [self.join(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
            nodes = paired + nodes[len(nodes) - len(nodes) % 2:]
        return nodes[0]

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for
    themselves, the rest are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _bpe(source: str) -> ByteBpe:
    return ByteBpe(source)


def _pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) for every row: token ids as little-endian unsigned 32-bit integers.

    With ``decoded``, column ``text`` has what the ids decode to, in the same pass.

    ``tokenizer`` is the path of the tokenizer file on the driver; its content, of a few
    MB whatever the data, is sent to the tasks. Texts longer than ``PART_CHARS`` are dealt
    out in parts, so that one huge text does not hold up a task."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    short = rows.filter(F.char_length("text") <= PART_CHARS)
    long = rows.filter(F.char_length("text") > PART_CHARS)

    extra = ", text string" if decoded else ""

    def encoder(*keep: str, back: bool = False):
        def make():
            bpe = _bpe(source.value)

            def work(batch: pa.RecordBatch):
                ids = [bpe.encode(t) for t in texts_of(batch)]
                columns = {c: batch.column(c) for c in keep}
                columns["ids"] = pa.array([_pack(x) for x in ids], pa.binary())
                if back:
                    columns["text"] = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

            return work

        return make

    plain = map_batches(short.select("id", "text"), encoder("id", back=decoded),
                        f"id {id_type}, ids binary{extra}")
    # Repeated rows of a long text are encoded once.
    once = long.groupBy("id", F.xxhash64("text").alias("h"), F.char_length("text").alias("n")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    parts = (
        once.select("id", "h", "n", "copies", F.explode(F.sequence(
            F.lit(0), F.floor((F.col("n") - 1) / PART_CHARS).cast("int"))).alias("part"), "text")
        .select("id", "h", "n", "copies", "part",
                F.substring(F.col("text"), F.col("part") * PART_CHARS + 1,
                            F.lit(PART_CHARS)).alias("text"))
        .repartition(F.col("id"), F.col("h"), F.col("part")))
    encoded = map_batches(
        parts, encoder("id", "h", "n", "copies", "part", "text"),
        f"id {id_type}, h bigint, n int, copies bigint, part int, text string, ids binary")

    def join_parts(group: pa.Table) -> pa.Table:
        """Parts of one text to its encoding."""
        bpe = _bpe(source.value)
        group = group.sort_by("part")
        nodes = [Node(text, np.frombuffer(ids, "<u4").tolist()) for text, ids in zip(
            group.column("text").to_pylist(), group.column("ids").to_pylist())]
        ids = bpe.join_all(nodes).ids
        columns = {"id": group.column("id").slice(0, 1), "copies": group.column("copies").slice(0, 1),
                   "ids": pa.array([_pack(ids)], pa.binary())}
        if decoded:
            columns["text"] = pa.array([bpe.decode(ids)], pa.string())
        return pa.table(columns)

    joined = encoded.groupBy("id", "h", "n").applyInArrow(
        join_parts, f"id {id_type}, copies bigint, ids binary{extra}")
    joined = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return plain.unionByName(joined.drop("copies", "_")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id",
           keep_ids: bool = True) -> DataFrame:
    """(id, ids, text) from :func:`encode`'s rows; null ids decode to the empty text."""
    with open(tokenizer, encoding="utf-8") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())
    id_type = encoded.schema[id_col].dataType.simpleString()

    def make():
        bpe = _bpe(source.value)

        def work(batch: pa.RecordBatch):
            texts = [bpe.decode(np.frombuffer(b or b"", "<u4").tolist())
                     for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("ids"), pa.array(texts, pa.string())],
                [id_col, "ids", "text"])

        return work

    out = map_batches(encoded.select(id_col, "ids"), make,
                      f"{id_col} {id_type}, ids binary, text string")
    return out if keep_ids else out.drop("ids")


def digests(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Token count and digests of ids and decoded text, from encoded rows; those that
    :func:`encode` has decoded as well are taken as they are."""
    if "text" not in encoded.columns:
        encoded = decode(encoded, tokenizer, id_col=id_col)
    return encoded.select(
        id_col, *keep,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
