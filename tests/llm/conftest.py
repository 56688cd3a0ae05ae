import pytest

from ordermill.llm.inputs import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def given(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, repeats, a long text, and columns with likely names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one two three"),
        (4, "one two three"),
        (None, "no id at all but some words to read in here"),
        (5, long),
        (6, "é中😀 Ünïcödé space   wide don't WE'LL 123"),
        (7, "a\n\nb\na\n\nb " + "same words again and again " * 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr(
        "doc_id",
        "text",
        "'en' AS lang",
        "'x' AS word",
        "'y' AS words",
        "1 AS row",
        "2 AS key",
        "array(1) AS hits",
        "3 AS n_words",
        "'z' AS node",
        "'q' AS ids",
        "0.5D AS score",
    )
