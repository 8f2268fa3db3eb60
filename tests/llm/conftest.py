import pytest

#: Hard cases that every operator on texts sees: null and empty texts, white space only,
#: repeated rows, repeated ids, null ids, ties, a long text, odd letters.
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(6000))
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
HARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \t\n ", "en", None), (4, "one", "en", "b"), (5, "one two", "en", "b"),
    (6, BASE, "en", "b"), (6, BASE, "en", "b"), (7, BASE, "en", None), (7, BASE + " more", "en", "c"),
    (None, BASE + " words at the end", "en", "c"), (None, None, None, None), (8, LONG, "en", "a"), (9, LONG[1:] + " x", "en", "a"),
    (10, "ÄÖÜ ß   naïve\r\nline\x0bend", "de", "ü"), (11, "a" * 3000, "en", "a"), (12, "\n".join(["same line here again"] * 5), "en", "a"),
]


@pytest.fixture
def hard(spark):
    """Documents with extra columns whose names clash with those the operators use."""
    rows = [(i, t, lang, src, None if t is None else len(t), 1, "x", 2.5) for i, t, lang, src in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc int, th string, size double")


@pytest.fixture
def empty(spark, hard):
    return spark.createDataFrame([], hard.schema)
