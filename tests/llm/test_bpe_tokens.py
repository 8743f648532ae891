import hashlib

import numpy as np
import pytest

from ledgerlens.llm import bpe, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", " ", "  ", "\n", "'s", "'", "re", "1", "23", "é", "<|endoftext|>", "<|",
          "endof", "|>", "!", "一", "字", "ж", "aaaa", "\t", " \n "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.ByteBpe(f.read())


def test_joins_agree_with_the_library(own, library, rng):
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(2, 80)))
        cut = rng.randint(1, len(text) - 1)
        left, right = (bpe.Node(t, own.flat(t)) for t in (text[:cut], text[cut:]))
        assert own.join(left, right).ids == library.encode(text, add_special_tokens=False).ids


def test_windows_grow_in_unsplit_text(own, rng, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", "ing", "th", "zz", "q"]) for _ in range(150))
        assert own.tree(text).ids == own.flat(text)


def test_round_trip_of_every_kind_of_text(spark, make_docs, library, prose, rng):
    long = prose(rng, 30_000)
    texts = [None, "", "plain text", "plain text", "x" * 100_000, long, long, "<|endoftext|>" * 3,
             " \n" * 40_000, "字" * 70_000]
    rows = bpe.digests(bpe.encode(make_docs(texts, extra=True), PATH), PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repeated_long_rows_stay(make_docs, spark):
    docs = make_docs(["ab " * 20_000])
    assert bpe.encode(docs.unionByName(docs), PATH).count() == 2
    rows = bpe.encode(docs.unionByName(docs), PATH, decoded=True).collect()
    assert [r.text for r in rows] == ["ab " * 20_000] * 2
    assert bpe.encode(make_docs([]), PATH).count() == 0


def test_token_counts_agree_with_the_library(make_docs, rng):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tokens.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=True)
    texts = [None, "", " ", "▁", "<s> <0x0A>", "鿿ꙮ" * 5, "a" * 3000] + [
        "".join(rng.choice([*PIECES, "鿿", "ing", "😀"]) for _ in range(40)) for _ in range(400)]
    rows = tokens.count(make_docs(texts, extra=True), pieces).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text
    assert tokens.count(make_docs([]), pieces).count() == 0


def test_ties_keep_the_longer_last_piece():
    # "abc" as a+bc or ab+c scores alike; the earlier start wins at the end.
    counter = tokens.Counter([("a", -1.0), ("b", -3.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0),
                              ("abc", -3.0)])
    assert counter.word("abc") == (1, -3.0)
