import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, odd white space, special strings, clashing extra columns."""
    rows = [
        (1, "The quick brown fox. It's 42\nlines<|endoftext|>deep", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "de"),
        (5, "a b\x0bc d\x1ce f  g", "fr"),
        (6, "Été İstanbul J̌ é ́x ß 日本語 🙂👍🏽 don't I'LL <|startoftext|> x", "fr"),
        (7, "wort " * 30_000 + "x" * 20_000, "de"),
        (1, "The quick brown fox. It's 42\nlines<|endoftext|>deep", "en"),
        (-8, "negative id and Token: abc", "en"),
    ]
    schema = "doc_id long, text string, lang string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "'s' as source", "length(text) as n_chars", "7 as n_tokens", "1L as block")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
