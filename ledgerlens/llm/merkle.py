"""Merkle manifest of a dataset, with a proof and a tampered version for every row.

Every row is a leaf, the SHA-256 of its columns. Leaves stand in groups (one a language),
ordered by id. Runs of ``FAN`` consecutive nodes become one node above until one node is left,
the subroot; subroots in the order of their groups are the leaves of the tree above them.

* Leaves are hashed by built-in expressions; after that only digests move.
* Trees are built in aligned blocks of ``FAN ** LEVELS`` nodes, each of which is a whole
  subtree, so that a group of any size is dealt out over tasks. The roots of the blocks are
  the nodes of the next round, and so on: every round is ``FAN ** LEVELS`` times smaller.
* A block's tree is persistent: replacing a leaf copies the nodes above it and shares all
  others, so each tampered leaf has a version of its own and none is undone. A version goes on
  above its block along the block's own path, joined to it from the upper rounds.

Cases: a null value counts as ``-``, any other as its byte count, ``:`` and its text; null
groups and null ids come first; repeated rows are leaves side by side; rows of one id follow
their digests; an empty table gives an empty result; long texts are hashed in place, never
moved; other columns are not carried along, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import numbered
from ledgerlens.session import materialise

#: Nodes that become one node above.
FAN = 8
#: Levels of a block: 4,096 leaves.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Node:
    """An inner node or leaf; never changed once made."""

    __slots__ = ("digest", "children")

    def __init__(self, digest: str, children: tuple[Node, ...] = ()):
        self.digest, self.children = digest, children


def above(children: Sequence[Node]) -> Node:
    return Node(digest("".join([c.digest for c in children])), tuple(children))


def depth(leaves: int) -> int:
    """Levels above so many leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def grow(digests: Sequence[str], levels: int) -> Node:
    """The tree of a block, ``levels`` above its leaves."""
    row = [Node(d) for d in digests]
    for _ in range(levels):
        row = [above(row[k:k + FAN]) for k in range(0, len(row), FAN)]
    return row[0]


def turns(place: int, levels: int) -> list[int]:
    """Which child to take at each level, from the root down, to a leaf's place."""
    return [place // FAN ** level % FAN for level in reversed(range(levels))]


def replaced(root: Node, way: Sequence[int], leaf: str) -> list[Node]:
    """The nodes that replacing one leaf copies, leaf first; all others are shared."""
    passed = [root]
    for turn in way:
        passed.append(passed[-1].children[turn])
    copies = [Node(leaf)]
    for node, turn in zip(reversed(passed[:-1]), reversed(way)):
        children = list(node.children)
        children[turn] = copies[-1]
        copies.append(above(children))
    return copies


def siblings(root: Node, way: Sequence[int]) -> list[tuple[str, str]]:
    """Digests before and after the path's node at each level, leaf level first."""
    found = []
    node = root
    for turn in way:
        found.append(("".join([c.digest for c in node.children[:turn]]),
                      "".join([c.digest for c in node.children[turn + 1:]])))
        node = node.children[turn]
    return found[::-1]


def climb(start: str, path: Sequence[tuple[str, str]]) -> list[str]:
    """The digests from ``start``, not included, to the root."""
    found = []
    for left, right in path:
        start = digest(left + start + right)
        found.append(start)
    return found


def field(column: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else byte count, colon and text."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def leaves(docs: DataFrame, *, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id",
           group_col: str = "lang", text_col: str = "text",
           tampered: Column | None = None) -> DataFrame:
    """(id, g, leaf, changed): digest of every row and, where ``tampered`` holds, that of the
    row with its text in lower case. ``g`` orders groups: null first, then by bytes."""
    group = F.col(group_col).cast("string")
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c)
               for c in columns]
    return docs.select(
        F.col(id_col).alias("id"),
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("g"),
        F.unhex(leaf([F.col(c) for c in columns])).alias("leaf"),
        F.when(F.lit(False) if tampered is None else tampered,
               F.unhex(leaf(changed))).alias("changed"))


_NODES = pa.schema([("g", pa.string()), ("place", pa.int64()), ("leaf", pa.binary())])
_PATHS = "g string, place bigint, block bigint, root binary, lefts array<string>, rights array<string>"


class Blocks:
    """Aligned blocks of nodes, each a whole subtree."""

    def __init__(self, levels: int = LEVELS):
        self.levels, self.width = levels, FAN ** levels

    def of(self, place: Column) -> Column:
        return F.floor(place / F.lit(self.width)).cast("long")

    def tree(self, group: pa.Table, block: int) -> tuple[pa.Table, Node, int]:
        """Nodes in order, their tree, and its height.

        All blocks of a group with several are of full height; the first is full then, so
        its own size gives its height in any case."""
        group = group.sort_by("place")
        levels = self.levels if block else depth(group.num_rows)
        return group, grow([d.hex() for d in group.column("leaf").to_pylist()], levels), levels

    def roots(self, nodes: DataFrame) -> DataFrame:
        """One node a block, as the next round's nodes."""
        def root(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            _, top, _ = self.tree(group, key[1].as_py())
            return pa.table({"g": [key[0].as_py()], "place": [key[1].as_py()],
                             "leaf": [bytes.fromhex(top.digest)]}, schema=_NODES)

        return self._dealt(nodes).applyInArrow(root, "g string, place bigint, leaf binary")

    def paths(self, nodes: DataFrame) -> DataFrame:
        """Every node with its block, the block's root, and its siblings inside the block."""
        def path(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            block, n, texts = key[1].as_py(), group.num_rows, pa.list_(pa.string())
            group, root, levels = self.tree(group, block)
            rows = [siblings(root, turns(k, levels)) for k in range(n)]
            return pa.table({
                "g": group.column("g"), "place": group.column("place"),
                "block": pa.array([block] * n, pa.int64()),
                "root": pa.array([bytes.fromhex(root.digest)] * n, pa.binary()),
                "lefts": pa.array([[a for a, _ in row] for row in rows], texts),
                "rights": pa.array([[b for _, b in row] for row in rows], texts)})

        return self._dealt(nodes).applyInArrow(path, _PATHS)

    def next(self, paths: DataFrame) -> DataFrame:
        return paths.filter(F.col("place") == F.col("block") * self.width).select(
            "g", F.col("block").alias("place"), F.col("root").alias("leaf"))

    def _dealt(self, nodes: DataFrame):
        return nodes.select("g", self.of(F.col("place")).alias("block"), "place", "leaf").groupBy(
            "g", "block")


def _upper(nodes: DataFrame, blocks: Blocks) -> tuple[DataFrame, DataFrame]:
    """(tops, paths) from block roots (g, place, leaf): one node a group, and for every
    input node its group's top and the siblings on its way there."""
    rounds: list[DataFrame] = []
    while (nodes.agg(F.max("place")).first()[0] or 0) > 0:
        rounds.append(materialise(blocks.paths(nodes), "paths"))
        nodes = blocks.next(rounds[-1])
    none = F.array().cast("array<string>")
    paths = nodes.select("g", "place", F.col("leaf").alias("top"),
                         none.alias("lefts"), none.alias("rights"))
    for lower in reversed(rounds):
        higher = paths.select("g", F.col("place").alias("block"), "top",
                              F.col("lefts").alias("more_lefts"),
                              F.col("rights").alias("more_rights"))
        paths = lower.join(higher, ["g", "block"]).select(
            "g", "place", "top", F.concat("lefts", "more_lefts").alias("lefts"),
            F.concat("rights", "more_rights").alias("rights"))
    return nodes, paths


def manifest(rows: DataFrame, blocks: Blocks) -> tuple[DataFrame, DataFrame]:
    """(placed, paths) of rows from :func:`leaves`.

    ``placed`` has the rows with their place in their group and their block; ``paths`` one row
    a block with the subroot of its group, the root of all, and the siblings above the block."""
    placed = materialise(
        _placed(rows, ["id", "leaf"]).withColumn("block", blocks.of(F.col("place"))), "leaves")
    tops, within = _upper(materialise(blocks.roots(placed), "blocks"), blocks)
    groups = materialise(_placed(
        tops.select(F.lit("").alias("g"), "leaf", F.col("g").alias("name")), ["name"]), "groups")
    lower = materialise(blocks.paths(groups), "groups")
    _, across = _upper(blocks.next(lower), blocks)
    across = across.select(F.col("place").alias("block"), F.col("top").alias("root"),
                           F.col("lefts").alias("last_lefts"), F.col("rights").alias("last_rights"))
    names = groups.select(F.col("name").alias("g"), "place")
    lower = lower.select("place", "block", F.col("lefts").alias("next_lefts"),
                         F.col("rights").alias("next_rights")).join(across, "block")
    over = names.join(lower, "place").drop("place", "block")
    return placed, within.join(over, "g").select(
        "g", F.col("place").alias("block"), F.col("top").alias("subroot"), "root",
        F.concat("lefts", "next_lefts", "last_lefts").alias("lefts"),
        F.concat("rights", "next_rights", "last_rights").alias("rights"))


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their place in their group, from 0."""
    return numbered(rows, ["g"], order, "place").withColumn(
        "place", F.col("place").cast("long") - 1)


def prove(docs: DataFrame, *, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id",
          group_col: str = "lang", text_col: str = "text", tampered: Column | None = None,
          versions: bool = False, levels: int = LEVELS) -> DataFrame:
    """For every row: leaf, subroot, root, digest of its proof's siblings, and the root that
    its (tampered, else own) leaf leads to. ``verified`` tells whether that is the root.

    With ``versions``, column ``version`` holds the nodes that a tampered row's version copies,
    from its leaf to its root; null for other rows."""
    rows = leaves(docs, columns=columns, id_col=id_col, group_col=group_col, text_col=text_col,
                  tampered=tampered)
    kind = rows.schema["id"].dataType.simpleString()
    blocks = Blocks(levels)
    placed, paths = manifest(rows, blocks)

    def verify(block: pa.Table, above_it: pa.Table) -> pa.Table:
        number = above_it.column("block")[0].as_py()
        block, root, levels = blocks.tree(block, number)
        upper = list(zip(above_it.column("lefts")[0].as_py(), above_it.column("rights")[0].as_py()))
        changed = block.column("changed").to_pylist()
        proofs, folded, copied = [], [], []
        upper_text = "".join([left + right for left, right in upper])
        for k, leaf in enumerate(block.column("leaf").to_pylist()):
            way = turns(k, levels)
            path = siblings(root, way)
            proofs.append(digest("".join([a + b for a, b in path]) + upper_text))
            if changed[k] is None:
                inside, version = [leaf.hex(), *climb(leaf.hex(), path)], None
            else:
                inside = version = [n.digest for n in replaced(root, way, changed[k].hex())]
            outside = climb(inside[-1], upper)
            folded.append((inside + outside)[-1])
            copied.append(version and version + outside)
        n = block.num_rows
        whole = above_it.column("root")[0].as_py().hex()
        return pa.table({
            "id": block.column("id"),
            "leaf": [d.hex() for d in block.column("leaf").to_pylist()],
            "subroot": [above_it.column("subroot")[0].as_py().hex()] * n,
            "root": [whole] * n, "proof_sha256": proofs, "folded_root": folded,
            "verified": [f == whole for f in folded],
            "version": pa.array(copied, pa.list_(pa.string()))})

    out = placed.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(
        verify, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, verified boolean, version array<string>")
    out = out.withColumnRenamed("id", id_col)
    return out if versions else out.drop("version")
