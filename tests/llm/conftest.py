import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, data string, key long, score double, size int, copies int, spans string, value string, word string"
WORDS = "alpha bravo carol delta echo fox golf hotel india juliet kilo lima mike nora oscar papa quebec romeo sierra tango".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + k * (seed + 3) * 31 + k * k) % len(WORDS)] + (str(k % 7) if k % 5 == 0 else "") for k in range(n))


def document(doc_id, text, source="s0"):
    """A row with columns whose names clash with those the operators use inside."""
    return (doc_id, text, "en", source, None if text is None else len(text), "r", "d", 1, 0.5, 9, 8, "x", "v", "w")


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, blanks, a very long text, ties and repeated rows."""
    return [
        document(1, sentence(1, 60)), document(2, sentence(1, 60), "s1"), document(3, None, None), document(4, ""), document(5, " \t\n "),
        document(6, "word"), document(6, "word"), document(7, sentence(2, 40_000), "s2"), document(None, sentence(3, 50)), document(None, None, "s1"),
        document(8, sentence(4, 30).upper(), None), document(9, "ä ö ü ß é à 漢字   emoji 😀 mail a.b@c.de +1 (234) 555-1234", "s3"),
        document(10, "the the the the the the", "s3"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "x") for i in range(11)] + [(1, 0, 1, "again"), (None, 1, 1, "x"), (5, None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def rows_of(df, *columns):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
