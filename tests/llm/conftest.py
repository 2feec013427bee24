import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it on was be with as by this are from at".split()


def prose(seed: int, n: int = 80) -> str:
    import random

    rng = random.Random(seed)
    made = ["".join(rng.choice(["tion", "er", "an", "th", "ou", "ing", "re"]) for _ in range(3)) for _ in range(40)]
    return " ".join(rng.choice(WORDS if rng.random() < 0.5 else made) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, and extra
    columns with names that the operators use themselves."""
    rows = [
        (1, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (2, prose(1), "en", "a", 1), (3, None, "en", "b", None),
        (4, "", None, None, 0), (5, " \t\n\x0b ", "en", "b", 3), (None, prose(2), None, None, None), (6, prose(3, 30_000), "fr", "c", 9),
        (7, "a", "xx", "b", 1), (8, "x" * 50_000 + "@" + "1" * 50_000, "en", "a", 2), (9, prose(4) + " write to jo.doe@mail.example.com now", "en", "c", 5),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    clash = ["fingerprint", "size", "_words", "word", "count", "h", "item", "b", "label", "n_words", "kept", "k", "copies"]
    return df.selectExpr("*", *[f"'{c}' as {c}" for c in clash])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small_docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
