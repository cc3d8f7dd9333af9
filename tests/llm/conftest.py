import pytest

TEXTS = [
    None, "", " ", "  a  b \n\n c\n d", "don't we'll I'd 'sx ''s x'sy a''re", "<|endoftext|>x <|startoftext|> <|endof",
    "naïve café Übung ﬁ ǅ İstanbul ΣΑΣ ς", "é ́x a̸", "日本語テスト 한국어 😀👩‍👩‍👧 ² ½ Ⅷ", "\t\t x\r\n y",
    "___ a_b __", "a" * 5000, "\x00\x01 \x7f", "same text twice", "same text twice", "word " * 9000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long, repeated and uncommon texts, with columns whose names clash with results."""
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, ids string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
