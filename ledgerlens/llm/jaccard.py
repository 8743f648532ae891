"""Exact Jaccard self-join on word shingles with signature trees.

Each distinct set of shingles is one class; copies only share its verdict. Two classes link
when their sets overlap enough. Classes that may link meet in groups, and inside a group a
signature tree does the join: its nodes hold the OR of their members' token bitmaps and the
range of their sizes, and a dual traversal drops a pair of nodes when the largest overlap
these allow is too small, or when both lie in one component already.

Groups come in two steps:

1. *Contraction.* Classes that share a key of min-hashes meet, with their whole sets. Most links are
   found here and merged to components. A large group is dealt out in blocks, and the blocks'
   leaders meet again in the next round, so no task holds an unbounded group.
2. *Completion.* By the prefix principle, linked sets share one of their first tokens in any
   common order. The order puts tokens last that a bounded sample shows to be frequent; it
   decides only the work, not the result. Where a token is shared by different components,
   bitmaps meet under it, and pairs that the trees leave are compared exactly.

So every link is either found or lies within one component; none is lost. Shingles stand for
their hashes: sizes are counted on 64 bits, sets are compared on the upper 48 of these. The
hash has no inputs that are bound to collide, but two shingles of a pair of sets may by chance.

Cases: null and blank texts have an empty set, link with nothing and form their own
component; repeated rows belong to one class; ties are broken by the least id; a null id is
never the name of a component unless no member has another; empty tables give an empty
result; a very long text is one set, of 6 bytes a shingle; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import bounded_batches, fresh, held_by_size, map_batches, texts_of
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import mix, shingle_set
from ledgerlens.session import materialise

#: Two sets link from this many hundredths of their union in common.
PERCENT = 80
#: Keys per class for contraction, and min-hashes that a key is made of: sets that only
#: share a passage rarely share a key, near copies nearly always share one.
KEYS = 4
HASHES = 3
#: Bits per token of a class's bitmap.
BITS_PER_TOKEN = 2
#: Children of a tree node.
FANOUT = 8
#: Classes that meet in one task at once.
BLOCK = 2_048
#: Tokens sampled to find frequent ones, and occurrences from which a token is frequent.
SAMPLE_TOKENS = 8_000_000
FREQUENT = 3
#: Rows that may be broadcast: a class and a group that it meets in, some 50 bytes each.
MOST_BROADCAST = 400_000
#: Classes a task remembers while it drops repeated ones.
SEEN = 500_000

_SALTS = mix(np.arange(101, 101 + KEYS * HASHES, dtype=np.uint64))


def pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: six bytes a token, in order."""
    return (tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def required(n: int) -> int:
    """Least overlap that a set of ``n`` needs for any link."""
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit per token, in a power of two of bits, about ``BITS_PER_TOKEN`` for each."""
    width = max(64, 1 << int(BITS_PER_TOKEN * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def contraction_keys(tokens: np.ndarray) -> list[int]:
    lowest = np.array([mix(tokens ^ salt).min() for salt in _SALTS])
    keys = np.zeros(KEYS, np.uint64)
    for column in lowest.reshape(KEYS, HASHES).T:
        keys = mix(keys + column)
    return keys.view(np.int64).tolist()


class Node:
    """A range of a group's members, in order of size."""

    __slots__ = ("bits", "width", "low", "high", "slack", "children", "member", "root")

    def __init__(self, bits, width, low, high, slack, children=(), member=-1):
        self.bits, self.width, self.low, self.high = bits, width, low, high
        self.slack, self.children, self.member = slack, children, member
        self.root = None


def fold(bits: int, width: int, to: int) -> int:
    """A bitmap in fewer bits: positions modulo the new width."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Tree:
    """Dual traversal of one group. ``test`` compares two members exactly; without it, pairs
    that cannot be ruled out are reported as they are."""

    def __init__(self, sizes, maps, roots, test=None):
        self.sizes, self.test = sizes, test
        self.parent: dict = {}
        self.roots = roots
        self.pairs: list[tuple[int, int]] = []
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        level = []
        for k in order:
            width = 8 * len(maps[k])
            bits = int.from_bytes(maps[k], "little")
            node = Node(bits, width, sizes[k], sizes[k], sizes[k] - bits.bit_count(), member=k)
            node.root = roots[k]
            level.append(node)
        while len(level) > 1:
            level = [self._parent(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
        if level:
            self._inside(level[0])

    @staticmethod
    def _parent(children: list[Node]) -> Node:
        width = min(c.width for c in children)
        bits, slack = 0, 0
        for c in children:
            folded = fold(c.bits, c.width, width)
            bits |= folded
            # Folding can merge a member's bits; count what its tokens may lose by it.
            slack = max(slack, c.slack if c.width == width
                        else c.slack + c.bits.bit_count() - folded.bit_count()
                        if c.member >= 0 else c.high)
        return Node(bits, width, children[0].low, children[-1].high, slack, children)

    def _find(self, x):
        parent = self.parent
        while x in parent:
            up = parent[x]
            if up in parent:
                parent[x] = parent[up]
            x = up
        return x

    def _same(self, a: Node, b: Node) -> bool:
        return a.root is not None and b.root is not None and \
            self._find(a.root) == self._find(b.root)

    def _inside(self, node: Node) -> None:
        children = node.children
        for c in children:
            if c.children:
                self._inside(c)
        for i, a in enumerate(children):
            for b in children[i + 1:]:
                self._across(a, b)
        roots = {None if c.root is None else self._find(c.root) for c in children}
        if len(roots) == 1:
            node.root = roots.pop()

    def _across(self, a: Node, b: Node) -> None:
        if self._same(a, b):
            return
        if a.low > b.low:
            a, b = b, a
        least = required(max(a.low, b.low))
        if a.high < least:
            return
        width = min(a.width, b.width)
        x, y = fold(a.bits, a.width, width), fold(b.bits, b.width, width)
        shared = (x & y).bit_count()
        if a.width == width and a.slack + shared < least:
            return
        if b.width == width and b.slack + shared < least:
            return
        if a.member >= 0 and b.member >= 0:
            # Every bit without a partner is a token without one.
            most = min(a.low - (x & ~y).bit_count(), b.low - (y & ~x).bit_count())
            if 100 * most < PERCENT * (a.low + b.low - most):
                return
            if self.test is None:
                self.pairs.append((a.member, b.member))
            elif self.test(a.member, b.member):
                self.pairs.append((a.member, b.member))
                self.parent[self._find(a.root)] = self._find(b.root)
            return
        for p in a.children or (a,):
            for q in b.children or (b,):
                self._across(p, q)


# --- tables --------------------------------------------------------------------------

CLASS = "struct<k:bigint,n:int>"


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               carry: tuple[Column, ...] = ()) -> DataFrame:
    """(id, c, keys, bits, tokens, then ``carry``, of type bigint, as t0, t1 ...) per row; ``c``
    names the class by a hash and the size."""
    carried = [f"t{k}" for k in range(len(carry))]
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch):
            k, n, keys, bits, tokens = [], [], [], [], []
            for text in texts_of(batch, "__text"):
                s = shingle_set(text)
                n.append(len(s))
                tokens.append(pack(s))
                bits.append(bitmap(s >> np.uint64(16)) if len(s) else b"")
                whole = mix(np.array([len(s)], np.uint64))
                if len(s):
                    mixed = np.bitwise_xor.reduce(mix(s + whole), keepdims=True)
                    whole = mix(mixed * np.uint64(3) + s.sum(keepdims=True))
                k.append(int(whole.astype(np.int64)[0]))
                keys.append(contraction_keys(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(k, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                 pa.array(tokens, pa.binary()), *(batch.column(f"__{t}") for t in carried)],
                ["id", "k", "n", "keys", "bits", "tokens", *carried])

        return work

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
                       *[x.alias(f"__{t}") for t, x in zip(carried, carry)])
    made = map_batches(rows, make, f"id {id_type}, k bigint, n int, keys array<bigint>, "
                                   "bits binary, tokens binary"
                                   + "".join(f", {t} bigint" for t in carried))
    return made.select("id", F.struct("k", "n").alias("c"), "keys", "bits", "tokens", *carried)


def _distinct_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of groups with more than one class, and the groups' sizes ``m``. Of groups with
    the same classes one stays: neighbouring shingles are shared by the same texts, so most
    groups repeat others. Groups are told apart by size and two 64-bit hashes."""
    marked = rows.groupBy(*group).agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y")).filter("m > 1")
    kept = marked.groupBy("m", "x", "y").agg(F.min(F.struct(*group)).alias("g"))
    return rows.join(kept.select("g.*", "m"), group)


def _meet(sets: DataFrame, meeting: DataFrame, column: str) -> DataFrame:
    """The meeting's rows with a column of each class; where a class has copies, perhaps
    several times. Sets travel once to each group that they meet in."""
    columns = [c for c in meeting.columns if c != "c"]
    listed = meeting.groupBy(F.col("c").alias("w")).agg(
        F.collect_list(F.struct(*columns)).alias("groups"))
    few = held_by_size(listed, meeting.count(), MOST_BROADCAST)
    rows = sets.join(few, F.col("c") == F.col("w")).select("c", column, "groups")
    kind = rows.schema["groups"].dataType.simpleString()
    once = map_batches(rows, _first_seen, f"c {CLASS}, {column} binary, groups {kind}")
    return once.select("c", column, F.explode("groups").alias("g")).select("c", column, "g.*")


def _first_seen():
    """Drop classes that a task has passed on already, before they are shuffled."""
    seen: set = set()

    def work(batch: pa.RecordBatch):
        c = batch.column("c")
        keys = list(zip(c.field("k").to_pylist(), c.field("n").to_pylist()))
        keep = []
        for i, key in enumerate(keys):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))

    return work


def _by_group(rows: DataFrame, group: list[str], tree) -> DataFrame:
    """Links (a, b) that ``tree(batch)`` finds in each group of rows."""
    bounded_batches(rows.sparkSession)
    dealt = rows.repartition(*[F.col(g) for g in group]).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*[_keys(batch.column(g)) for g in group]))
            edge = 0
            for i, key in enumerate(keys):
                if key != last:
                    if last is not None:
                        if i > edge:
                            held.append(batch.slice(edge, i - edge))
                        yield from _links(tree, held)
                        held = []
                    last, edge = key, i
            held.append(batch.slice(edge))
        yield from _links(tree, held)

    return dealt.mapInArrow(run, f"a {CLASS}, b {CLASS}")


def _keys(column: pa.Array) -> list:
    """A group column's values in a form that compares."""
    if pa.types.is_struct(column.type):
        return list(zip(*[column.field(k).to_pylist() for k in range(column.type.num_fields)]))
    return column.to_pylist()


_CLASS_TYPE = pa.struct([("k", pa.int64()), ("n", pa.int32())])


def _links(tree, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if sum(map(len, held)) < 2:
        return
    group = pa.Table.from_batches(held).combine_chunks()
    classes = group.column("c").to_pylist()
    # Copies of one text bring their class more than once.
    once = {(c["k"], c["n"]): i for i, c in enumerate(classes)}
    if len(once) < 2:
        return
    if len(once) < len(classes):
        group = group.take(list(once.values()))
        classes = group.column("c").to_pylist()
    pairs = tree(group, classes)
    if pairs:
        sides = [sorted((classes[i], classes[j]), key=lambda c: (c["k"], c["n"]))
                 for i, j in pairs]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[k] for s in sides], _CLASS_TYPE) for k in (0, 1)], ["a", "b"])


def _exact_tree(group: pa.Table, classes: list[dict]):
    tokens = [unpack(t) for t in group.column("tokens").to_pylist()]
    return Tree([c["n"] for c in classes], [bitmap(t) for t in tokens],
                list(range(len(classes))), lambda i, j: linked(tokens[i], tokens[j])).pairs


def _bound_tree(group: pa.Table, classes: list[dict]):
    comps = [(c["k"], c["n"]) for c in group.column("comp").to_pylist()]
    return Tree([c["n"] for c in classes], group.column("bits").to_pylist(), comps).pairs


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their class: itself where it has no links."""
    if labels is None:
        return rows.withColumn("comp", F.col("c"))
    return rows.join(labels.select(F.col("node").alias("c"), "comp"), "c", "left").withColumn(
        "comp", F.coalesce("comp", "c"))


def contract(sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Links found through min-hashes, and the components they make."""
    keyed = materialise(sets.filter(F.size("keys") > 0).select(
        "c", F.posexplode("keys").alias("r", "key")).distinct(), "keyed")
    edges = labels = None
    while True:
        leaders = _labelled(keyed, labels).groupBy("r", "key", "comp").agg(F.min("c").alias("c"))
        leaders = materialise(leaders.select("r", "key", "c"), "leaders")
        groups = materialise(_distinct_groups(leaders, ["r", "key"]), "groups")
        largest = groups.agg(F.max("m")).first()[0]
        if largest is None:
            return edges, labels
        meeting = groups.select("r", "key", "c", F.pmod(
            F.xxhash64("c"), F.ceil(F.col("m") / BLOCK)).alias("block"))
        found = materialise(_by_group(
            _meet(sets, meeting, "tokens"), ["r", "key", "block"], _exact_tree).distinct(),
            "links")
        if found.isEmpty():
            return edges, labels
        edges = found if edges is None else edges.unionByName(found)
        labels = materialise(components(edges), "labels")
        if largest <= BLOCK:
            return edges, labels


def frequent_tokens(sets: DataFrame) -> np.ndarray:
    """Tokens seen often in a sample of about ``SAMPLE_TOKENS`` tokens, ascending; at most a
    third as many, whatever the size of the corpus."""
    total = sets.agg(F.sum(F.col("c.n").cast("long"))).first()[0] or 0
    share = min(1.0, SAMPLE_TOKENS / max(1, total))
    sample = sets.filter(
        F.pmod(F.xxhash64("c.k"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def explode():
        seen = _first_seen()

        def work(batch: pa.RecordBatch):
            for kept in seen(batch):
                tokens = [unpack(t) for t in kept.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64))], ["token"])

        return work

    counted = map_batches(sample.select("c", "tokens"), explode, "token bigint").groupBy(
        "token").agg(F.count("*").alias("m")).filter(F.col("m") >= FREQUENT).select("token")
    found = counted.toArrow().column("token").to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) else np.empty(0, np.uint64)


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, c): the first tokens of each class in the common order."""
    frequent = sets.sparkSession.sparkContext.broadcast(frequent_tokens(sets))

    def make():
        seen, last = _first_seen(), frequent.value

        def work(batch: pa.RecordBatch):
            for kept in seen(batch):
                c = kept.column("c")
                for lo in range(0, len(kept), 64):
                    part = kept.slice(lo, 64)
                    out, owner = [], []
                    for i, t in enumerate(part.column("tokens").to_pylist()):
                        t = unpack(t)
                        late = np.zeros(len(t), bool)
                        if len(last):
                            at = np.searchsorted(last, t)
                            at[at == len(last)] = 0
                            late = last[at] == t
                        first = np.concatenate([t[~late], t[late]])[:len(t) - required(len(t)) + 1]
                        out.append(first)
                        owner.append(np.full(len(first), lo + i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out).view(np.int64)),
                         c.take(pa.array(np.concatenate(owner)))], ["token", "c"])

        return work

    return map_batches(sets.filter(F.col("c.n") > 0).select("c", "tokens"), make,
                       f"token bigint, c {CLASS}")


def complete(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links between different components that share a prefix token."""
    of_token = Window.partitionBy("token")
    shared = prefixes(sets).repartition("token").withColumns({
        "least": F.min("c").over(of_token), "most": F.max("c").over(of_token)}).filter(
        F.col("least") != F.col("most")).select("token", "c")
    shared = materialise(shared.distinct(), "shared")
    shared = _distinct_groups(shared, ["token"])
    mixed = _labelled(shared, labels).withColumns({
        "low": F.min("comp").over(of_token), "high": F.max("comp").over(of_token),
        "hub": F.min("c").over(of_token)}).filter(F.col("low") != F.col("high"))
    # Groups with one least class are joined as one, so that a class comes to them once.
    mixed = materialise(mixed.select("hub", "c", "comp").distinct(), "mixed")
    sizes = mixed.groupBy("hub").agg(F.count("*").alias("m"))
    # Blocks of a large group meet two by two.
    blocks = F.ceil(F.col("m") / BLOCK)
    own = F.pmod(F.xxhash64("c"), blocks)
    met = mixed.join(sizes, "hub").select("hub", "c", "comp", own.alias("own"), F.explode(
        F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    met = met.select("hub", "c", "comp", F.least("own", "other").alias("low"),
                     F.greatest("own", "other").alias("high"))
    pairs = materialise(_by_group(
        _meet(sets, met, "bits"), ["hub", "low", "high"], _bound_tree).distinct(), "pairs")
    # Each class meets those paired with it; it comes along to every block of them.
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m"))
    sides = pairs.join(sizes, "a").select(
        F.col("a").alias("hub"), F.col("b").alias("c"),
        F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / BLOCK)).alias("block"))
    hubs = sides.select("hub", F.col("hub").alias("c"), "block").distinct()
    meeting = materialise(sides.unionByName(hubs), "meeting")
    return _by_group(_meet(sets, meeting, "tokens"), ["hub", "block"], _exact_tree)


def _rows(sets: DataFrame, *columns: str) -> DataFrame:
    """(c, columns, comp) for every row of the sets."""
    edges, labels = contract(sets)
    more = materialise(complete(sets, labels), "links")
    if not more.isEmpty():
        edges = more if edges is None else edges.unionByName(more)
        labels = materialise(components(edges), "labels")
    return _labelled(sets.select("c", *columns), labels)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    sets = materialise(signatures(docs, id_col=id_col, text_col=text_col), "sets")
    rows = _rows(sets, "id")
    named = rows.filter(F.col("c.n") > 0).groupBy("comp").agg(F.min("id").alias("component_id"))
    return rows.join(named, "comp", "left").select(
        F.col("id").alias(id_col), F.col("c.n").cast("long").alias("n_shingles"),
        F.when(F.col("c.n") > 0, F.col("component_id")).otherwise(F.col("id"))
        .alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns: the one with the least id, null ids
    last. Rows are told apart by id and text: of rows that repeat both one stays, and another
    text under the same id stays or goes by its own component. Texts without words have no
    component; those without an id all stay."""
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sets = materialise(
        signatures(docs, id_col=id_col, text_col=text_col, carry=(text_key,)), "sets")
    rows = materialise(_rows(sets, "id", "t0"), "components")
    worded = rows.filter(F.col("c.n") > 0)
    first = worded.groupBy("comp").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "t0")).alias("b"))
    name, key = fresh(docs, "__id"), fresh(docs, "__key")
    named = (F.col("id").alias(name), F.col("t0").alias(key))
    gone = materialise(worded.join(first, "comp").filter(
        ~(F.col("id").eqNullSafe(F.col("b.id")) & (F.col("t0") == F.col("b.t0")))).select(
        *named).distinct(), "gone")
    same = F.col(id_col).eqNullSafe(F.col(name)) & (text_key == F.col(key))
    kept = docs.join(held_by_size(gone, gone.count(), MOST_BROADCAST), same, "left_anti")
    again = rows.filter((F.col("c.n") > 0) | F.col("id").isNotNull()).groupBy(*named).agg(
        F.count("*").alias("m")).filter("m > 1").select(name, key)
    repeated = again.count()
    if not repeated:
        return kept
    again = held_by_size(again, repeated, MOST_BROADCAST)
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").withColumn(key, text_key)
        .dropDuplicates([id_col, key]).drop(key))
