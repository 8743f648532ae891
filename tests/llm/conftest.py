import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside, to clash with theirs.
EXTRA = ("h", "id", "key", "c", "doc", "score", "__id", "__text", "spans", "found")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with further columns whose names operators use themselves."""
    def make(texts, *, first=0, extra=False, langs=None):
        rows = [(first + k, t, langs[k] if langs else "en", f"src{k % 3}", len(t or ""))
                for k, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, DOCS)
        for name in EXTRA if extra else ():
            docs = docs.selectExpr("*", f"'x' AS `{name}`")
        return docs

    return make


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def prose():
    """Texts of made-up words, the same for a seed."""
    def make(rng, n, size=900):
        words = [f"w{k}" for k in range(size)]
        return " ".join(rng.choice(words) for _ in range(n))

    return make
