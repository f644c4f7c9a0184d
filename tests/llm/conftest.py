import pytest

LONG = "long words without end " * 20_000
EXTRA = "key long, ids string, score string, digest string, n long, s string, host string, path string, topic string, p_doc string, row long, label string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    extra = (1, "x", "y", "z", 5, "t", "h", "/p", "topic", "p", 9, "label")
    prose = "The quick brown fox jumps over the lazy dog and runs away from here"
    rows = [
        (1, prose, "en", "a", 67),
        (2, prose, "en", "a", 67),
        (2, prose, "en", "a", 67),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, LONG, "en", None, len(LONG)),
        (6, "Le chat est sur la table avec un chien qui dort", "fr", "b", 10),
        (7, "!!! ### $$$ 123", "de", "b", 3),
        (None, "no id here but words all the same", "en", "a", 5),
        (None, None, None, None, None),
        (8, "日本語のテキスト\nعربي\u3000ñandú 'tis it's 'll", "es", "c", 9),
        (9, " \n\t \n ", "en", "c", 9),
        (10, "Released under the MIT License. mit license", "en", "c", 9),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
