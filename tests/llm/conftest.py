import pytest

#: Texts that every operator must take: nulls, blanks, repeats, non-ASCII, one long text.
TEXTS = [
    "the quick brown fox jumps over the lazy dog again and again", None, "", "   \n\t ", "the quick brown fox jumps over the lazy dog again and again",
    "Été à Paris: l'été ΟΔΟΣ, 日本語 テスト 😀 <|endoftext|> x</w>", "one", "a b c", "long " * 3000 + "end", "the quick brown fox sleeps under one warm tree now and forever", "A\x0bB\x0cC\x1cD\x85E F",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, _id long, _text string, component_id string, language string, copies int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls everywhere, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, None if i == 4 else f"s{i % 2}", None if t is None else len(t), "x", -1, -2, "other", "c", "zz", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
