import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle


def every_third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    """All levels of a tree by plain lists."""
    found = [nodes]
    while len(found[-1]) > 1:
        row = found[-1]
        found.append([sha("".join(row[k:k + 8])) for k in range(0, len(row), 8)])
    return found


def way_up(levels, place):
    path = []
    for row in levels[:-1]:
        start = place // 8 * 8
        path.append(("".join(row[start:place]), "".join(row[place + 1:start + 8])))
        place //= 8
    return path


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0,
                                         leaf(r, r["text"])))
        trees[name] = levels_of([leaf(r, r["text"]) for r in groups[name]])
    upper = levels_of([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for k, row in enumerate(groups[name]):
            path = way_up(trees[name], k) + way_up(upper, g)
            text, doc_id = row["text"], row["doc_id"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for left, right in path:
                folded = sha(left + folded + right)
            root = upper[-1][0]
            out.append((doc_id, trees[name][0][k], trees[name][-1][0], root,
                        sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 4])
def test_agrees_with_plain_lists(make_docs, rng, levels):
    texts = [None, "", "Ä ÖABC", "plain"] + [
        "".join(rng.choice("aAbB é") for _ in range(rng.randint(1, 30))) for _ in range(230)]
    langs = [None, "en", "de", "z"] + [rng.choice(["en"] * 8 + ["é", None, "fr"]) for _ in texts[4:]]
    docs = make_docs(texts, langs=langs, extra=True).repartition(3)
    rows = [r.asDict() for r in docs.collect()]
    result = merkle.prove(docs, tampered=every_third(), levels=levels)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                              "verified"]
    assert sorted(map(tuple, result.collect()), key=str) == brute(rows)


def test_null_and_repeated_ids_one_group_and_empty(make_docs, spark):
    docs = make_docs(["Ab", "Ab", "cD" * 50_000], langs=["en"] * 3)
    docs = docs.unionByName(docs).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(0)))
    rows = [r.asDict() for r in docs.collect()]
    result = merkle.prove(docs, tampered=every_third())
    assert sorted(map(tuple, result.collect()), key=str) == brute(rows)
    assert merkle.prove(make_docs([])).count() == 0
    alone = merkle.prove(make_docs(["x"])).first()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root
    assert alone.proof_sha256 == sha("") and alone.verified


def test_versions_share_what_they_do_not_copy():
    leaves = [sha(str(k)) for k in range(70)]
    root = merkle.grow(leaves, 3)
    before = [node.digest for node in root.children]
    copies = merkle.replaced(root, merkle.turns(9, 3), sha("new"))
    assert len(copies) == 4 and copies[0].digest == sha("new")
    top = copies[-1]
    assert top.digest != root.digest
    assert [node.digest for node in root.children] == before
    assert top.children[1] is root.children[1]
    assert top.children[0].children[0] is root.children[0].children[0]
    assert top.children[0].children[1] is copies[1]
    again = levels_of(leaves[:9] + [sha("new")] + leaves[10:])
    assert top.digest == again[-1][0]


def test_versions_as_rows(make_docs):
    docs = make_docs(["AB"] * 20)
    rows = merkle.prove(docs, tampered=F.col("doc_id") == 3, versions=True).collect()
    changed = [r for r in rows if r.version]
    assert [r.doc_id for r in changed] == [3]
    assert len(changed[0].version) == 3 and changed[0].version[-1] == changed[0].folded_root
    assert not changed[0].verified and all(r.verified for r in rows if r.doc_id != 3)
