import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, row string, score double"
LONG = " ".join(f"word{i % 977} other{i % 13}." for i in range(15_000))
TEXTS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a"), (2, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "fr", "b"),
    (6, LONG, "en", "b"), (7, LONG + " end", None, None), (None, "le chat est sur la table et il regarde", "fr", None), (None, None, None, None),
    (8, "THE CAT sat on  the\nmat and looked at the dog", "en", "a"), (9, "One two", "en", "c"), (10, "one TWO", "en", "c"),
    (11, "…!?42", "fr", "c"), (-3, "le chien dort sur la chaise et le chat est sur la table", "fr", "a"),
    (12, "x" * 5000, "en", "d"), (13, "a<|endoftext|>b  İ² \U0001f600́", "en", "d"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that operators use as names."""
    rows = [(i, t, lang, s, None if t is None else len(t), 7, "slot", "row", 0.5) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
