import hashlib
from collections import Counter

import pytest

from ledgerlens.llm import align

public_tokenizers = pytest.importorskip("public_tokenizers")
FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "the", " ", "  ", "\n", "'s", "re", "123", "é", "<|endoftext|>", "</s>", "<0x41>",
          "字", "ж", "aaaa", "\t", "😀", "ing", "▁", "\x00"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def spelled(text):
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        names = [second.id_to_piece(i) for i in b]
        return (list(zip(a.ids, [bytes(letters[c] for c in t) for t in a.tokens])),
                [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x")
                  else p.replace("▁", " ").encode()) for i, p in zip(b, names)])

    return spelled


def ends(tokens):
    place, found = 0, []
    for i, spelled in tokens:
        place += len(spelled)
        found.append((place, i))
    return found


def brute(texts, spelled):
    kept = []
    for text in texts:
        a, b = spelled(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        ok = text and b"".join(s for _, s in a) == whole == b"".join(s for _, s in b)
        kept.append((ends(a), ends(b)) if ok else ([], []))
    pairs = []
    for a, b in kept:
        second = dict(b)
        pairs.append([(i, second[p]) for p, i in a if p in second])
    count = Counter(x for row in pairs for x in row)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (a, b), row in zip(kept, pairs):
        common = {p for p, _ in a} & {p for p, _ in b}
        sides = []
        for side in (a, b):
            cut, open_ids = [], []
            for p, i in side:
                open_ids.append(str(i))
                if p in common:
                    cut.append(",".join(open_ids))
                    open_ids = []
            sides.append(cut)
        groups = ["|".join(x) for x in zip(*sides)]
        out.append((len(a), len(b), len(common), len(row), sum(count[x] == best[x[1]] for x in row),
                    sum(count[x] for x in row),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if common else ""))
    return out


@pytest.mark.parametrize("share", [align.HEAVY_SHARE, 0.02])
def test_agrees_with_plain_loops(make_docs, libraries, rng, prose, monkeypatch, share):
    monkeypatch.setattr(align, "HEAVY_SHARE", share)
    texts = [None, "", " ", "▁", "plain text", "plain text", "<|endoftext|> </s>", "x" * 9000,
             prose(rng, 20_000), "two words"] + [
        "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    docs = make_docs(texts, extra=True).repartition(3)
    result = align.align(docs, FIRST, SECOND)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                              "count_sum", "groups_sha256"]
    rows = {r.doc_id: tuple(r)[1:] for r in result.collect()}
    want = brute(texts, libraries)
    assert len(rows) == len(texts)
    for k, row in enumerate(want):
        assert rows[k] == row, texts[k]
    assert rows[3] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table_and_null_ids(make_docs, spark):
    assert align.align(make_docs([]), FIRST, SECOND).count() == 0
    docs = spark.createDataFrame([(None, "same"), (None, "same")], "doc_id bigint, text string")
    rows = align.align(docs, FIRST, SECOND).collect()
    assert len(rows) == 2 and all(r.count_sum == 2 * r.n_links > 0 for r in rows)


def test_counts_of_pairs(make_docs, libraries):
    docs = make_docs(["one two", "one two", "one"])
    counts = align.pair_counts(align.link(docs, FIRST, SECOND)).collect()
    assert sum(r["count"] for r in counts) == 5 and all(r.best for r in counts)
    assert max(r["count"] for r in counts) == 3
