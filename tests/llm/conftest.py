import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, score double, spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names operators use themselves."""

    def build(rows):
        return spark.createDataFrame(
            [(doc, text, lang, source, None if text is None else len(text), "c", 0.5, "s") for doc, text, lang, source in rows], DOCS
        )

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tied, repeated and very long texts, null ids and groups."""
    long_text = " ".join(f"word{i % 997} turns{i % 31}." for i in range(30_000))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (4, "One word.", "xx", "b"),
        (5, "One word.", "en", "b"),
        (6, long_text, "en", "a"),
        (6, long_text, "en", "a"),
        (None, "No id here, but some words. They are few. Yes.", "en", None),
        (7, "Größe ist Ärger. ퟿ \U0001f600 ok | # * $ % & < >", "de", "a"),
    ]
