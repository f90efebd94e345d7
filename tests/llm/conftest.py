import pytest

TEXTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, host string, label string"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank and very long texts, repeated rows; columns that clash with inner names."""
    long = " ".join(f"w{i}" for i in range(30_000)) + "\n" + "x" * 20_000
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, long), (6, "Same text here for all of us."),
        (6, "Same text here for all of us."), (7, "SAME text here for all of us."), (8, "123 456 #$ \x1c\x85 |"),
        (None, "A row without an id has words too."), (None, None), (9, "é ü 漢字 \U0001f600 e\u0301"),
    ]
    full = [(i, t, "en" if i != 9 else None, None if i == 4 else "s", 0, 1, "h", "l") for i, t in rows]
    return spark.createDataFrame(full, TEXTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], TEXTS)


@pytest.fixture(scope="session")
def vocabularies():
    import public_tokenizers

    return {name: public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")} | {
        "pattern": public_tokenizers.PATTERN
    }


