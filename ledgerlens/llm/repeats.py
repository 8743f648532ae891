"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix counts only through its first ``DEPTH`` bytes. Sorting suffixes to that depth
would put equal windows side by side; as only equality matters, each pass splits groups by
the next digit and drops groups with a single member, most significant digit first:

1. The first digit of a window is its *anchor*: the least hash among the short grams inside
   it, leftmost on ties. Equal windows have equal anchors at equal places. Neighbouring
   windows mostly share one anchor, so a run of windows is one row.
2. Runs left open are cut into blocks of neighbouring windows at fixed places from the anchor;
   the next digit is the hash of the bytes that all windows of a block contain.
3. Blocks left open are cut into windows; the last digit is the hash of the window itself.

At each pass, rows alike in all bytes that they cover are repeated as a whole and settled;
rows whose digit occurs once are dropped; the rest is left open for the next pass, with one
settled row of each kind as a witness. Groups of equal windows are exactly the repeated
strings. All their bytes are removed. Windows are compared by two 64-bit hashes.

Cases: null and empty texts have no bytes; texts shorter than ``DEPTH`` lose nothing; very
long texts are handled in overlapping pieces of ``PIECE`` bytes;
overlapping strings and repeats within one document count; repeated rows are documents that
repeat each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_by_size, map_batches, texts_of
from ledgerlens.llm.shingles import mix, prefix_sums, substring_hashes
from ledgerlens.session import materialise

#: Length of strings that may not repeat, and of the grams that anchor them, in bytes.
DEPTH = 200
GRAM = 64
#: Bytes of a text handled at once; the next piece overlaps by ``DEPTH - 1``.
PIECE = 1 << 20
#: Neighbouring windows in a block.
BLOCK = 8
#: Rows that may be broadcast: an open row or a document's spans, some 30 bytes each.
MOST_BROADCAST = 1_000_000

_PLACE = np.uint64((1 << 24) - 1)
_SECOND = np.uint64(0xA0761D6478BD642F)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by block-wise running minima."""
    n = len(values)
    size = -(-n // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def window_runs(data: np.ndarray):
    """Runs of neighbouring windows with one anchor: (first, last, anchor place) and the
    prefix sums to hash with. ``last`` is the last window's start."""
    sums = prefix_sums(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = substring_hashes(sums, places, places + GRAM)
    # The gram's hash above, its place below: the leftmost of equal grams wins.
    ranked = (grams & ~_PLACE) | places.astype(np.uint64)
    anchors = (sliding_min(ranked, DEPTH - GRAM + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], len(anchors)) - 1
    at = anchors[first]
    return first, last, at, grams[at], sums


def pieces(data: np.ndarray):
    """(offset, bytes) of a text's pieces; every window lies in exactly one."""
    for lo in range(0, max(1, len(data) - DEPTH + 1), PIECE):
        yield lo, data[lo:lo + PIECE + DEPTH - 1]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _batch(doc: pa.Array, parts: list[tuple], names: list[str]):
    """One batch from parts (text number, columns...)."""
    if parts:
        owner, *columns = (np.concatenate(c) for c in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [doc.take(pa.array(owner)), *(pa.array(c.view(np.int64)) for c in columns)],
            ["doc", *names])


def _fresh(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """Texts that the task has not seen: copies are settled as whole texts."""
    keep = []
    for k, doc in enumerate(batch.column("doc").to_pylist()):
        doc = (doc["h"], doc["n"])
        if doc not in seen:
            seen.add(doc)
            keep.append(k)
    return batch.take(pa.array(keep, pa.int64()))


def _runs():
    """First pass: (doc, digit, whole, first, last, place of the anchor)."""
    seen: set = set()

    def work(batch: pa.RecordBatch):
        batch, parts = _fresh(batch, seen), []
        for k, text in enumerate(texts_of(batch)):
            data = _bytes(text)
            for lo, piece in pieces(data):
                first, last, at, gram, sums = window_runs(piece)
                # The place of the anchor inside the run is part of what must agree.
                whole = mix(substring_hashes(sums, first, last + DEPTH) * _SECOND
                            + (at - first).astype(np.uint64))
                parts.append((np.full(len(first), k), gram, whole, first + lo, last + lo, at + lo))
        yield from _batch(batch.column("doc"), parts, COLUMNS)

    return work


def _opened(batch: pa.RecordBatch):
    """For each text's pieces with open rows: (text number, piece's start, its prefix sums,
    and the rows' first, last and anchor places inside the piece)."""
    lists = batch.column("open").to_pylist()
    for k, text in enumerate(texts_of(batch)):
        rows = np.array([(r["first"], r["last"], r["at"]) for r in lists[k]], np.int64)
        data = _bytes(text)
        for lo, piece in pieces(data):
            mine = rows[(rows[:, 0] >= lo) & (rows[:, 0] < lo + PIECE)]
            if len(mine):
                yield (k, lo, prefix_sums(piece), *(mine - lo).T)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from low to high, row by row, and their rows."""
    sizes = high - low + 1
    row = np.repeat(np.arange(len(low)), sizes)
    return low[row] + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), row


def _blocks():
    """Second pass, on open runs."""
    seen: set = set()

    def work(batch: pa.RecordBatch):
        batch, parts = _fresh(batch, seen), []
        for k, lo, sums, first, last, at in _opened(batch):
            # A window's offset is the distance from its start to its anchor.
            block, row = _spread((at - last) // BLOCK, (at - first) // BLOCK)
            a = np.maximum(first[row], at[row] - BLOCK * block - (BLOCK - 1))
            b = np.minimum(last[row], at[row] - BLOCK * block)
            core = at[row] - BLOCK * block
            digit = mix(substring_hashes(sums, core, core + DEPTH - BLOCK + 1) * _SECOND
                        + block.astype(np.uint64))
            whole = mix(substring_hashes(sums, a, b + DEPTH) * _SECOND
                        + (at[row] - a).astype(np.uint64))
            parts.append((np.full(len(a), k), digit, whole, a + lo, b + lo, at[row] + lo))
        yield from _batch(batch.column("doc"), parts, COLUMNS)

    return work


def _windows():
    """Third pass, on open blocks; a row is one window, alike only if its digit is."""
    seen: set = set()

    def work(batch: pa.RecordBatch):
        batch, parts = _fresh(batch, seen), []
        for k, lo, sums, first, last, at in _opened(batch):
            start, _ = _spread(first, last)
            own = substring_hashes(sums, start, start + DEPTH)
            half = substring_hashes(sums, start, start + DEPTH // 2)
            parts.append((np.full(len(start), k), own, half, start + lo, start + lo, start + lo))
        yield from _batch(batch.column("doc"), parts, COLUMNS)

    return work


def _merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [start, end) covered by windows that start from ``first`` to ``last``."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + DEPTH)
    begins = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return a[begins], b[np.append(begins[1:], len(a)) - 1]


COLUMNS = ["digit", "whole", "first", "last", "at"]
DOC = "struct<h:bigint,n:int>"
PASS = f"doc {DOC}, " + ", ".join(f"{c} bigint" for c in COLUMNS)


def _sift(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(settled, open) rows of a pass. Digits, and what is alike under one, are found by
    aggregates that combine before their shuffle; rows only look up the result. So no digit's
    rows meet in one task, however many texts share it."""
    place = F.xxhash64("doc.h", "doc.n", "first")
    rows = materialise(rows, name)
    digits = materialise(rows.groupBy("digit").agg(
        F.min(place).alias("low"), F.max(place).alias("high"),
        F.min("whole").alias("least"), F.max("whole").alias("most")).filter(
        "low < high").select("digit", (F.col("least") == F.col("most")).alias("settled")),
        f"{name}_digits")
    shared = materialise(rows.join(held_by_size(digits, digits.count(), MOST_BROADCAST), "digit"),
                         f"{name}_shared")
    mixed = shared.filter(~F.col("settled"))
    kinds = materialise(mixed.groupBy("digit", "whole").agg(
        (F.min(place) < F.max(place)).alias("repeated"),
        F.min(F.struct("doc", "first", "last", "at")).alias("row")), f"{name}_kinds")
    repeated = kinds.filter("repeated").select("digit", "whole")
    alike = mixed.join(held_by_size(repeated, repeated.count(), MOST_BROADCAST),
                       ["digit", "whole"], "left_semi")
    # A kind found once stays open; of any other under its digit, one row is a witness.
    unsure = kinds.filter(~F.col("repeated")).select("digit").distinct()
    opened = kinds.join(held_by_size(unsure, kinds.count(), MOST_BROADCAST), "digit", "left_semi")
    columns = ["doc", "first", "last"]
    return (shared.filter("settled").select(columns).unionByName(alike.select(columns)),
            opened.select("row.*"))


def _next_pass(rows: DataFrame, opened: DataFrame, make) -> DataFrame:
    """Rows of the next pass from the texts that have open rows."""
    listed = materialise(opened.groupBy(F.col("doc").alias("d")).agg(
        F.collect_list(F.struct("first", "last", "at")).alias("open")), "open")
    weight = listed.agg(F.sum(F.size("open") + 1)).first()[0] or 0
    few = held_by_size(listed, weight, MOST_BROADCAST)
    chosen = rows.join(few, F.col("doc") == F.col("d")).select("doc", "text", "open")
    return map_batches(chosen, make, PASS)


def spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(doc, spans): for each text that has any, its repeated byte ranges, as pairs of little-
    endian 64-bit integers. ``doc`` is a hash of the text and its length: equal texts are
    repeated alike."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(
        F.octet_length("text") >= DEPTH).select(
        F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("doc"),
        "text")
    copied = rows.groupBy("doc").agg(F.count("*").alias("m")).filter("m > 1").select(
        "doc", F.lit(0).cast("long").alias("first"),
        (F.col("doc.n") - DEPTH).cast("long").alias("last"))
    settled, opened = _sift(map_batches(rows, _runs, PASS), "runs")
    more, opened = _sift(_next_pass(rows, opened, _blocks), "blocks")
    last, _ = _sift(_next_pass(rows, opened, _windows), "windows")
    ranges = copied.unionByName(settled).unionByName(more).unionByName(last)
    # Copies of a text in several tasks bring the same ranges: sets take them once.
    listed = ranges.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("r")).select(
        "doc", F.col("r.first").alias("first"), F.col("r.last").alias("last"))

    def merge():
        def work(batch: pa.RecordBatch):
            out = []
            for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist()):
                start, end = _merge(np.asarray(a, np.int64), np.asarray(b, np.int64))
                out.append(np.stack([start, end], axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(out, pa.binary())], ["doc", "spans"])

        return work

    return map_batches(listed, merge, f"doc {DOC}, spans binary")


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans) for every row; ``kept`` holds the bytes left."""
    found = materialise(spans(docs, text_col=text_col), "spans")
    # A text has any number of spans, so their bytes are counted, not its rows.
    weight = found.agg(F.sum(F.octet_length("spans") + 32)).first()[0] or 0
    few = held_by_size(found, weight, 32 * MOST_BROADCAST)
    rows = docs.select(F.col(id_col).alias("__id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.struct(
        F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut():
        def work(batch: pa.RecordBatch):
            kept, n, gone, count = [], [], [], []
            for text, packed in zip(texts_of(batch), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                pairs = np.frombuffer(packed or b"", "<i8").reshape(-1, 2).tolist()
                parts, at, removed = [], 0, 0
                for a, b in pairs:
                    parts.append(data[at:a])
                    removed += b - a
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                n.append(len(data))
                gone.append(removed)
                count.append(len(pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(count, pa.int64())],
                [id_col, "kept", "n_bytes", "n_removed", "n_spans"])

        return work

    joined = rows.join(few, "doc", "left").select("__id", "text", "spans")
    return map_batches(joined, cut, f"`{id_col}` {id_type}, kept binary, n_bytes bigint, "
                                    "n_removed bigint, n_spans bigint")


def digests(removed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans",
                          F.sha2("kept", 256).alias("kept_sha256"))
