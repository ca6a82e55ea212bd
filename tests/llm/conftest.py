import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, digest string, _text string, taken string"
LONG = "very long words repeat here and there " * 20_000


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing column names."""
    base = [
        (1, "One two three four five six seven eight nine ten.", "en", "b"),
        (1, "One two three four five six seven eight nine ten.", "en", "b"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "de", "a"), (5, "1234 !!", "en", None),
        (6, LONG, "en", "b"), (7, "One two three four five six seven eight nine ten.", "en", "a"),
        (None, "no id at all in this row, none", "en", "b"), (9, "😀 emoji é́ x", "fr", "c"),
        ((1 << 62) + 1, "a large id that a double cannot hold", "en", "c"),
    ]
    return [(*r, None, 7, 0.5, "d", "t", "x") for r in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(a, None if b is None else b.encode("utf-16", "surrogatepass").decode("utf-16"), *c)
                                  for a, b, *c in odd_rows()], ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
