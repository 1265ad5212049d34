import pytest

#: Columns of documents, and names that operators use inside.
EXTRA = ["row_id", "digest", "fp", "n", "kept", "words", "lines", "bucket", "size", "score", "start", "label", "_key", "found", "island"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def make_docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) + ("x",) * len(EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "lorem ipsum dolor sit amet consectetur 12 " * 5000
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "a" * 100_000), (6, "Hello World, hello again and again."), (6, "Hello World, hello again and again."), (7, "hello world, HELLO again and again."),
    (None, "no id here at all"), (8, "null meta", None, None), (9, "\\ </s> [INST] \\\\ ~ $1"), (10, "ß É 😀 日本語 é"), (11, "1.2.3.4 +12 345 678 90 a@b.co 4111 1111 1111 1111"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return make_docs(spark, EDGES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
