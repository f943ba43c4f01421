import pytest

from chatlens.plans.adapters import table

#: Documents with every odd case: null, empty and blank texts, a null id, repeated rows, a long text, columns that operators
#: use as names of their own.
WORDS = [f"w{i % 97}x{i % 89}" for i in range(60_000)]
ODD = [
    (1, None, "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \n\t ", None, None),
    (None, "the cat sat on the mat and the dog ran", "en", "s2"),
    (4, "one", "en", "s2"),
    (5, " ".join(WORDS), "en", "s2"),
    (6, " ".join(WORDS[:59_000]), "de", "s3"),
    (6, " ".join(WORDS[:59_000]), "de", "s3"),
    (7, "x" * 70_000, "de", "s3"),
    (8, "Größe übel <|endoftext|> <s> password=abcdefgh12345678 \x00 😀", "de", "s3"),
]
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, key string, node long, digest string, "
    "live long, label int, at int, h1 long, shared string, block long"
)


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, g, s, len(t or ""), 1, "k", 2, "d", 3, 1, 4, 5, "x", 6) for i, t, g, s in ODD]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture
def make(spark):
    """Documents with the given texts, ids from 0 on."""

    def docs(texts, sources=None):
        rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return docs
