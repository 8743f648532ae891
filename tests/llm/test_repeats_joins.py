import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import components, decontaminate, jaccard, queries, repeats
from ledgerlens.llm import shingles as word_shingles


def shingles(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    name = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = [new if n == old else n for n in name]
    return name, [len(s) for s in sets]


def near_copies(rng, prose):
    texts = [None, "", "  ", "one", "One", "a b c", "a b c"]
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.randint(6, 160)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "word"])
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:9]) + " " + passage)
    return texts


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_components_against_all_pairs(make_docs, rng, prose, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(rng, prose)
    names, sizes = brute_components(texts)
    out = {r.doc_id: r for r in jaccard.join(make_docs(texts, extra=True)).collect()}
    assert [out[k].component_id for k in range(len(texts))] == names
    assert [out[k].n_shingles for k in range(len(texts))] == sizes


def test_completion_alone_finds_every_link(make_docs, rng, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "contract", lambda sets: (None, None))
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    texts = near_copies(rng, prose)
    out = {r.doc_id: r.component_id for r in jaccard.join(make_docs(texts)).collect()}
    assert [out[k] for k in range(len(texts))] == brute_components(texts)[0]


def test_trees_report_all_links_of_a_group(rng):
    import numpy as np

    sets = []
    for _ in range(12):
        base = [rng.randrange(1 << 60) for _ in range(rng.randint(1, 120))]
        sets.append(base)
        for _ in range(4):
            sets.append(base[:max(1, int(len(base) * rng.uniform(0.7, 1)))])
    arrays = [np.unique(np.array(s, np.uint64)) for s in sets]
    n = len(arrays)
    tree = jaccard.Tree([len(a) for a in arrays], [jaccard.bitmap(a) for a in arrays], list(range(n)))
    found = {frozenset(p) for p in tree.pairs}
    links = {frozenset((i, j)) for i in range(n) for j in range(i)
             if jaccard.linked(arrays[i], arrays[j])}
    assert links <= found and len(found) < n * (n - 1) / 4


def test_one_document_of_each_group_stays(make_docs, rng, prose):
    text = prose(rng, 40)
    docs = make_docs([text, text, "other words", None, text + " end"], extra=True)
    kept = jaccard.keep_one(docs.unionByName(docs.filter("doc_id = 0")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == docs.columns
    assert jaccard.keep_one(make_docs([])).count() == 0


def test_ids_on_several_texts_and_null_ids(spark, rng, prose):
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, d), (None, c), (None, None), (None, None),
            (None, "only here"), (None, "only here"), (5, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r.doc_id, r.text or None) for r in jaccard.keep_one(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [
        (1, a), (2, b), (3, c), (3, d), (None, None), (None, None), (None, "only here"), (5, None)]))


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    out = dict(components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    assert {out[k] for k in range(61)} == {0} and out[101] == out[100] == 100
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(texts):
    depth, seen, out = repeats.DEPTH, {}, []
    data = [(t or "").encode() for t in texts]
    for b in data:
        for k in range(len(b) - depth + 1):
            seen[b[k:k + depth]] = seen.get(b[k:k + depth], 0) + 1
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k:k + depth]] > 1:
                gone[k:k + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_repeated_bytes_against_brute_force(make_docs, rng, prose, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    passage, other = prose(rng, 70), "é" * 150 + prose(rng, 30)
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 201, "z" * 1000]
    for k in range(30):
        parts = [prose(rng, rng.randint(5, 120))]
        for p in (passage, other, passage[:230], passage[40:300]):
            if rng.random() < 0.4:
                parts += [p, prose(rng, rng.randint(0, 60))]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], passage, passage + "!", prose(rng, 3000)]
    want = brute_repeats(texts)
    removed = repeats.digests(repeats.remove(make_docs(texts, extra=True)))
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed.collect()}
    assert [out[k] for k in range(len(texts))] == want
    assert repeats.remove(make_docs([])).count() == 0


def test_a_string_that_very_many_texts_share(spark, make_docs, rng, prose):
    line = prose(rng, 60)
    texts = [f"{prose(rng, rng.randint(0, 30))} {line} {prose(rng, rng.randint(0, 30))}"
             for _ in range(300)] + [line] * 40
    removed = repeats.digests(repeats.remove(make_docs(texts).repartition(16)))
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed.collect()}
    assert [out[k] for k in range(len(texts))] == brute_repeats(texts)


ITEMS = "item_id bigint, text string"


def test_decontamination_tolerates_substitutions(spark, make_docs, rng, prose):
    items = [prose(rng, n, size=5000).split() for n in (7, 15, 24, 60)] + [["tiny", "item"]]
    texts, held = [None, "", prose(rng, 300, size=5000)], {}
    for k, item in enumerate(items[:4]):
        for changed in (0, 1, len(item) // 8):
            copy = list(item)
            for at in rng.sample(range(len(copy)), min(changed, len(copy) // 5)):
                copy[at] = "changed"
            held[len(texts)] = k
            texts.append(" ".join([prose(rng, 30, size=5000), *copy, prose(rng, 9, size=5000)]))
        half = item[:len(item) // 3] if k < 3 else item[:20]
        if len(half) >= 13:
            held[len(texts)] = k
        texts.append(prose(rng, 20, size=5000) + " " + " ".join(half).upper() + ".")
    table = spark.createDataFrame(
        [(k, " ".join(i)) for k, i in enumerate(items)] + [(8, None), (9, "")], ITEMS).selectExpr(
        "*", "1 AS h", "2 AS seed")
    docs = make_docs(texts, extra=True)
    out = decontaminate.find(docs, table).collect()
    assert {r.doc_id: r.item_id for r in out} == held
    assert all(r.n_equal >= 0.8 * r.n_words for r in out if r.n_words < 60)
    again = decontaminate.find(docs.unionByName(docs), table)
    assert again.count() == 2 * len(out)
    rest = decontaminate.remove(docs, table)
    assert {r.doc_id for r in rest.collect()} == set(range(len(texts))) - set(held)
    assert rest.columns == docs.columns
    assert decontaminate.find(make_docs([]), table).count() == 0
    assert decontaminate.find(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(5, 6, 7, 8, 9), (10, 11, 12, 13, 14), (15, 16)])
def test_every_placement_of_allowed_changes_is_found(spark, make_docs, sizes):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in sizes}
    texts, held = [], []
    for n, item in items.items():
        for changed in itertools.combinations(range(n), n // 5):
            held.append((n, n - len(changed)))
            texts.append(" ".join(["a", "b", *("x" if k in changed else w for k, w in enumerate(item)), "c"]))
    table = spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], ITEMS)
    out = {r.doc_id: (r.item_id, r.n_equal, r.start)
           for r in decontaminate.find(make_docs(texts), table).collect()}
    assert out == {k: (*h, 2) for k, h in enumerate(held)}


def test_masks_leave_no_allowed_choice_of_changes_uncovered():
    kept = [{at + k for k in decontaminate.MASKS[m]} for at, m in decontaminate.PLACES]
    assert all(len(k) == 4 and k < set(range(5)) for k in kept)
    assert {5 * 4 // 2 - sum(k) for k in kept} == set(range(5))
    for n in range(5, 18):
        for changed in itertools.combinations(range(n), n // 5):
            hits = sum(not any(5 * s + k in changed for k in mask)
                       for s in range(n // 5) for mask in kept)
            assert hits >= min(n // 5, 5)


def brute_items(texts, items):
    """Best placement of every item in every text, by laying it at every offset."""
    def plain(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w.strip(decontaminate.EDGES) for w in re.split(r"[\x20\x09-\x0D]+", low) if w]

    found = set()
    for d, text in enumerate(map(plain, texts)):
        for i, item in enumerate(map(plain, items)):
            best = None
            for start in range(1 - len(item), len(text)):
                if min(len(item), len(text)) < decontaminate.LEAST_WORDS:
                    break
                same = [0 <= start + k < len(text) and text[start + k] == w
                        for k, w in enumerate(item)]
                run = top = 0
                for x in same:
                    run = max(run + (1 if x else -4), 0)
                    top = max(top, run)
                if (sum(same) >= decontaminate.LEAST_SHARE * len(item)
                        or top >= decontaminate.LEAST_STRETCH):
                    best = max(best or (0, 0), (sum(same), -start))
            if best:
                found.add((d, i, -best[1], len(item), best[0]))
    return found


def test_decontamination_equals_a_scan_of_every_placement(spark, make_docs, rng, prose):
    """Few different words, so that chance overlaps just above and below the limits abound."""
    items = [prose(rng, n, size=4) for n in (4, 5, 6, 9, 10, 14, 21, 33)] + ["a a a a a a a", None]
    texts = [None, "", "a", "a " * 40]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 12), size=4)]
        for item in rng.sample(items[:-1], 2):
            w = item.split()
            cut = w[rng.randint(0, 4):len(w) - rng.randint(0, 4)]
            for at in rng.sample(range(len(cut)), min(len(cut), rng.randint(0, len(w) // 4))):
                cut[at] = "other"
            parts += [" ".join(cut), prose(rng, rng.randint(0, 12), size=4)]
        texts.append(" ".join(parts))
    long_text = prose(rng, 3000, size=40)
    texts.append(f"{long_text} {items[7]}, {long_text}")
    table = spark.createDataFrame(list(enumerate(items)), ITEMS)
    out = decontaminate.find(make_docs(texts), table).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words, r.n_equal) for r in out} == brute_items(
        texts, items)


def test_stretches_of_long_items_are_found_wherever_they_start(spark, make_docs):
    item = [f"w{k}" for k in range(59)]
    texts = []
    for at in range(59 - 18 + 1):
        texts.append(" ".join(["a", *item[at:at + 13], "b"]))
        texts += [" ".join(["a", *item[at:at + k], "x", *item[at + k + 1:at + 18], "b"]) for k in range(1, 17)]
    table = spark.createDataFrame([(1, " ".join(item))], ITEMS)
    assert decontaminate.find(make_docs(texts), table).count() == len(texts)
    # Texts under five words match nothing, though four of an item's five words are there.
    short = spark.createDataFrame([(2, "p q r s t")], ITEMS)
    assert [r.doc_id for r in decontaminate.find(
        make_docs(["p q r s", "z p q r s"]), short).collect()] == [1]


def test_removal_takes_only_the_rows_that_hold_an_item(spark, prose, rng):
    item, clean, other = prose(rng, 30), prose(rng, 60, size=700), prose(rng, 60, size=700)
    bad = f"{clean} {item} {other}"
    rows = [(None, bad), (None, clean), (None, None), (None, bad), (7, bad), (7, other), (7, ""), (8, bad)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key")
    rest = decontaminate.remove(docs, spark.createDataFrame([(1, item)], ITEMS))
    assert rest.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in rest.collect()))) == sorted(
        str(r) for r in rows if r[1] != bad)


def test_pipeline_stages_and_sql(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)
    stage = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "jaccard_join", "decontamination", "personal_data"):
        extended = docs.withColumns({n: F.lit("x") for n in ("score", "__id", "__lang", "h")})
        out = stage[name](spark, extended, sf_dir)
        assert out.columns == extended.columns
        assert stage[name](spark, docs.limit(0), sf_dir).count() == 0
    assert stage["bpe"](spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(got.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _opposite_words(size):
    """Two words of Thue-Morse letters, equal under every polynomial modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_of_one_polynomial_hash_stay_apart(make_docs):
    one, two = _opposite_words(2048)
    assert not set(word_shingles.shingle_set(one).tolist()) & set(word_shingles.shingle_set(two).tolist())
    rows = jaccard.join(make_docs([f"one two three {one}", f"one two three {two}"])).collect()
    assert [r.component_id for r in sorted(rows)] == [0, 1]


def test_word_hashes_depend_on_every_byte(rng):
    import numpy as np

    words = {bytes(rng.choice(b"abcdef") for _ in range(rng.randint(1, 40))) for _ in range(3000)}
    words |= {b"a" * k for k in range(1, 60)} | {b"\0" * k for k in range(1, 20)}
    words = sorted(words)
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    found = word_shingles.word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(found.tolist())) == len(words)
    again = word_shingles.word_hashes(data[3:], (ends - [len(w) for w in words])[5:] - 3, ends[5:] - 3)
    assert (again == found[5:]).all()
