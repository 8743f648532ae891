import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact


def brute(rows, best=max):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = best((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), keep == doc_id,
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("budget, keep", [(exact.BUDGET, "largest"), (20_000, "smallest")])
def test_groups_agree_with_brute_force(make_docs, rng, budget, keep):
    texts = [None, "", "a", "a ", "A", "ä" * 3000, "x" * 50_000, "x" * 50_000] + [
        rng.choice("abc") * rng.randint(1, 40) for _ in range(300)] + ["hot copy"] * 200
    docs = make_docs(texts, extra=True).repartition(5)
    result = exact.find(docs, keep=keep, budget=budget)
    assert result.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    best = max if keep == "largest" else min
    assert got(result) == brute(list(enumerate(texts)), best)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (None, "b"), (5, "c"), (5, "c"), (5, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(exact.find(docs)) == brute(rows)
    kept = exact.distinct(docs)
    assert sorted(map(tuple, kept.collect()), key=str) == [(3, "a"), (5, "c"), (5, "d"), (None, "b")]


def test_distinct_keeps_columns(make_docs):
    docs = make_docs(["one", "two", "one", None, ""], extra=True)
    kept = exact.distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_empty_table(make_docs):
    assert exact.find(make_docs([])).count() == 0
    assert exact.distinct(make_docs([])).count() == 0


def test_equal_heads_are_told_apart(spark, make_docs, monkeypatch):
    """Texts of one length under one content hash stay apart: bytes decide."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    texts = ["abcd", "abce", "xbcd", "abcd"]
    assert got(exact.find(make_docs(texts))) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("close", [False, True])
def test_trie_loses_nothing_when_it_spills(close):
    rng = random.Random(3)
    out = []
    trie = exact.Trie(max, lambda *entry: out.append(entry), 3000, close)
    want = {}
    for n in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12)))
        want[key] = (max(n, want.get(key, (0, 0))[0]), want.get(key, (0, 0))[1] + 1)
        trie.insert(key, n, 1)
        assert close or trie.size <= 3000
    held = list(trie.entries())
    assert out and held
    spilled = {key for key, *_ in out}
    if close:
        assert not spilled & {key for key, *_ in held}
    found = {}
    for key, owner, count in out + held:
        a, b = found.get(key, (0, 0))
        found[key] = (max(a, owner), b + count)
    assert found == want


def test_paths_are_compressed():
    trie = exact.Trie(max, None, 1 << 20)
    for key in (b"romane", b"romanus", b"romulus"):
        trie.insert(key, 1, 1)
    (top,) = trie.root.children.values()
    assert top.label == b"rom" and {c.label for c in top.children.values()} == {b"an", b"ulus"}
