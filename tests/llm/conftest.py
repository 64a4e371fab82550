import pytest

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside; they must not clash.
    "key string, kind string, h long, row_id long, word string, component_id long, score double"
)


@pytest.fixture(scope="session")
def documents_of(spark):
    def build(rows):
        """Documents from (doc_id, text[, lang[, source]]) tuples, with extra columns of clashing names."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 len(r[1]) if r[1] is not None else None, "k", None, 1, 2, "w", 3, 0.5) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_documents(documents_of):
    """Nulls in every column, empty and very long texts, repeated rows."""
    long_text = " ".join(f"word{i % 977}\n" if i % 50 == 0 else f"w{i % 1013}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "The quick brown fox jumps over the lazy dog"),
        (5, "The quick brown fox jumps over the lazy dog"), (None, "no id here at all"), (None, None),
        (6, "x" * 5000), (7, long_text, None, None), (8, "☃ \U0001f600 éè \x00 ▁ tab\tend"),
        (9, "The quick brown fox jumps over the lazy dog", None, None),
    ]
    return documents_of(rows)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
