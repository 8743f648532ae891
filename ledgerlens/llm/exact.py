"""Exact duplicates by owners in Patricia tries.

A key is a text's length and content hash, then its bytes; a compressed radix trie holds each
distinct key once, and the node where a key ends keeps the id that owns it and how many rows
it stands for.

* Map side: every task inserts its rows into a trie of its own, so that a text which makes up
  a third of the table leaves a task once, not once a row. Past ``budget`` bytes the trie
  spills by subtree: whole subtrees leave as rows until half of it is free.
* Owners: rows are dealt out by length and content hash and inserted again, full byte strings
  compared. A subtree spilled here stays closed: its later keys follow it, and all of them
  are dealt out anew, to as many tasks as their bytes need, in the next pass. Spilled rows
  lie in the shared folder, so a lost executor costs a task's work and no data.
* Verdicts: rows learn their owner by the digest of their text. Groups of a thousandth of all
  rows or more, of which there are at most a thousand, are broadcast; the rest are joined by
  shuffle.

Cases: a null text counts as empty; an empty table gives an empty result; of equal ids in a
group all rows are marked kept (:func:`distinct` keeps one of them); a null id owns a group
only if all its ids are null; a text longer than ``budget`` makes a subtree of its own and
passes through; other columns are not carried along, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, fresh
from ledgerlens.session import materialise

#: Bytes that a task's trie may hold before it spills.
BUDGET = 48 << 20
#: What a node costs besides its label.
NODE_BYTES = 300
#: Groups from this share of all rows are broadcast: at most as many as its inverse.
HEAVY_SHARE = 1e-3
#: Bytes of a batch of spilled or finished keys.
OUT_BYTES = 8 << 20
#: Bytes of length and content hash at the head of a key.
HEAD = 16


class Node:
    __slots__ = ("label", "children", "owner", "count", "closed")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = None
        self.count = 0
        self.closed = False


class Trie:
    """A compressed radix trie from byte strings to (owner, count), bounded by spilling.

    ``better(a, b)`` picks the owner of two ids; ``out(key, owner, count)`` takes spilled keys.
    With ``close``, a spilled subtree stays closed and later keys below it go straight out."""

    def __init__(self, better: Callable, out: Callable, budget: int, close: bool = False):
        self.root = Node(b"")
        self.better, self.out, self.budget, self.close = better, out, budget, close
        self.size = self.keys = 0

    def insert(self, key: bytes, owner, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.closed:
                return self.out(key, owner, count)
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += NODE_BYTES + len(child.label)
            elif not key.startswith(child.label, at):
                child = self._split(node, child, _shared(child.label, key, at))
            at += len(child.label)
            node = child
        if node.closed:
            return self.out(key, owner, count)
        if node.count:
            node.owner = self.better(node.owner, owner)
        else:
            node.owner = owner
            self.keys += 1
        node.count += count
        if self.size > self.budget:
            self.spill()

    def _split(self, parent: Node, child: Node, n: int) -> Node:
        upper = Node(child.label[:n])
        parent.children[upper.label[0]] = upper
        child.label = child.label[n:]
        upper.children[child.label[0]] = child
        self.size += NODE_BYTES
        return upper

    def spill(self) -> None:
        """Send whole subtrees out, largest first, until half of the budget is free.

        A closing trie keeps at least one key, so every pass settles some."""
        sizes, ends = {}, {}
        for node, done in _walk(self.root):
            if done:
                below = [id(c) for c in node.children.values()]
                sizes[id(node)] = NODE_BYTES + len(node.label) + sum(sizes[k] for k in below)
                ends[id(node)] = (node.count > 0) + sum(ends[k] for k in below)
        cuts, ahead = [], [(self.root, b"", None)]
        while ahead:
            node, prefix, parent = ahead.pop()
            if parent is not None and (sizes[id(node)] <= self.size // 8 or not node.children):
                if not node.closed:
                    cuts.append((sizes[id(node)], len(cuts), node, prefix, parent))
            else:
                below = prefix + node.label
                ahead += [(c, below, node) for c in node.children.values()]
        for size, _, node, prefix, parent in sorted(cuts, key=lambda c: c[:2], reverse=True):
            if self.size <= self.budget // 2:
                break
            if self.close and self.keys == ends[id(node)] > 0:
                continue
            for entry in _entries(node, prefix):
                self.out(*entry)
            self.size -= size
            self.keys -= ends[id(node)]
            if self.close:
                # Nothing else lies below the label's beginning: it closes the place as well.
                node.label = node.label[:HEAD]
                node.children, node.count, node.owner, node.closed = {}, 0, None, True
                self.size += NODE_BYTES + len(node.label)
            else:
                del parent.children[node.label[0]]

    def entries(self) -> Iterator[tuple]:
        return _entries(self.root, b"")


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the beginning that ``label`` shares with ``key`` from ``at``."""
    return len(os.path.commonprefix([label, key[at:at + len(label)]]))


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every node before and after those below it, without recursion."""
    ahead = [(root, False)]
    while ahead:
        node, done = ahead.pop()
        yield node, done
        if not done:
            ahead.append((node, True))
            ahead += [(c, False) for c in node.children.values()]


def _entries(root: Node, prefix: bytes) -> Iterator[tuple]:
    """(key, owner, count) of every key in a subtree."""
    ahead = [(root, prefix)]
    while ahead:
        node, before = ahead.pop()
        key = before + node.label
        if node.count:
            yield key, node.owner, node.count
        ahead += [(c, key) for c in node.children.values()]


class _Rows:
    """Rows on their way out, given back in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    def batches(self, least: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """(text_sha256, owner, size): each distinct text with the id that owns it and its rows."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    better = _larger if keep == "largest" else _smaller
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.col(id_col).alias("owner"))
    rows = rows.select(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"),
                       "text", "owner", F.lit(1).cast("long").alias("size"))
    kind = rows.schema["owner"].dataType.simpleString()
    partial = f"n int, h bigint, text binary, owner {kind}, size bigint"
    final = f"text_sha256 string, {partial}"

    def keyed(batch: pa.RecordBatch):
        n, h, text, owner, size = (
            batch.column(c).to_pylist() for c in ("n", "h", "text", "owner", "size"))
        for k, t in enumerate(text):
            head = n[k].to_bytes(8, "big") + h[k].to_bytes(8, "big", signed=True)
            yield head + t, owner[k], size[k]

    def parts(key: bytes) -> tuple:
        return (int.from_bytes(key[:8], "big"), int.from_bytes(key[8:HEAD], "big", signed=True),
                key[HEAD:])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = None, None
        for batch in batches:
            if trie is None:
                out = _Rows(batch.schema)
                trie = Trie(better, lambda key, owner, size: out.add(
                    (*parts(key), owner, size), len(key)), budget)
            for entry in keyed(batch):
                trie.insert(*entry)
                yield from out.batches()
        if trie is not None:
            for key, owner, size in trie.entries():
                out.add((*parts(key), owner, size), len(key))
                yield from out.batches()
            yield from out.batches(0)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = None, None
        for batch in batches:
            if trie is None:
                out = _Rows(pa.schema([pa.field("text_sha256", pa.string()), *batch.schema]))
                trie = Trie(better, lambda key, owner, size: out.add(
                    (None, *parts(key), owner, size), len(key)), budget, close=True)
            for entry in keyed(batch):
                trie.insert(*entry)
                yield from out.batches()
        if trie is not None:
            for key, owner, size in trie.entries():
                digest = hashlib.sha256(memoryview(key)[HEAD:]).hexdigest()
                out.add((digest, None, None, None, owner, size), 64)
                yield from out.batches()
            yield from out.batches(0)

    dealt = rows.mapInArrow(combine, partial).repartition("n", "h")
    settled, turn = [], 0
    while True:
        turn += 1
        found = materialise(dealt.mapInArrow(settle, final), "owners")
        settled.append(found.filter("text_sha256 IS NOT NULL").select(
            "text_sha256", "owner", "size"))
        left = found.filter("text_sha256 IS NULL").drop("text_sha256")
        size = left.agg(F.sum(F.octet_length("text") + NODE_BYTES)).first()[0]
        if size is None:
            break
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * size // budget)
        dealt = left.repartition(tasks, F.col("n"), F.col("h"), F.lit(turn))
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _owned(rows: DataFrame, found: DataFrame, key: str, owner: str, size: str) -> DataFrame:
    """Rows with the owner and size of their group; both null for texts that occur once."""
    total = found.agg(F.sum("size")).first()[0] or 0
    least = max(2, int(total * HEAVY_SHARE) + 1)
    groups = found.select(F.col("text_sha256").alias(key), F.col("owner").alias(owner),
                          F.col("size").alias(size)).filter(F.col(size) > 1)
    # At most 1 / HEAVY_SHARE groups can hold that share of all rows, so they are broadcast.
    heavy = F.broadcast(groups.filter(F.col(size) >= least))
    light = groups.filter(F.col(size) < least)
    return rows.join(heavy, key).unionByName(
        rows.join(heavy, key, "left_anti").join(light, key, "left"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row."""
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("text_sha256")), "digests")
    found = owners(docs, id_col=id_col, text_col=text_col, keep=keep, budget=budget)
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("owner"))
    return _owned(rows, found, "text_sha256", "owner", "size").select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")


def distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """The rows that own their text, one for each distinct text, with all their columns."""
    sha, owner, size = (fresh(docs, c) for c in ("__sha", "__owner", "__size"))
    found = owners(docs, id_col=id_col, text_col=text_col, keep=keep, budget=budget)
    rows = _owned(docs.withColumn(sha, _digest(F.col(text_col))), found, sha, owner, size)
    alone = rows.filter(F.col(size).isNull())
    first = rows.filter(F.col(size).isNotNull() & F.col(owner).eqNullSafe(F.col(id_col)))
    return alone.unionByName(first.dropDuplicates([sha])).select(*docs.columns)
