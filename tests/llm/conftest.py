import pytest

NASTY = [
    (1, "The cat sat on the mat. It was a fine day for all of them.\nThen it rained."),
    (2, None),
    (3, ""),
    (4, "The cat sat on the mat. It was a fine day for all of them.\nThen it rained."),
    (5, "   \n\t  "),
    (6, "x" * 300),
    (7, "word " * 9000),
    (7, "word " * 9000),
    (8, "Éa ñ 漢字 😀 it's 'twas 12,345.67 don't stop <|endoftext|> now"),
    (None, "no id"),
    (None, None),
    (9, "Licensed under the Apache License, Version 2.0. This work is CC BY 4.0."),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", f"s{n}", None, n, 0.5, True) for n, (i, t) in enumerate(NASTY)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, n long, score double, kept boolean",
    )


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 10)] + [(None, 1, 1), (3, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def known_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
