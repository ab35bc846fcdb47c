import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, h1 string, token string, n_words string, block string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 997}q{i % 31}" for i in range(30_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base.upper(), "b"), (4, base + " extra", None), (5, "", "a"), (6, None, "b"), (7, "one two", "b"),
        (8, "one two", "a"), (8, "one two", "a"), (9, "  \t\n ", None), (10, long, "a"), (11, "x " + long, "a"), (None, base, "a"), (12, None, None),
        (13, "line one\nline one\nline one\n" * 30, "c"), (14, "straße ΑΒΓ émigré " * 30, "c"),
    ]
    return spark.createDataFrame([(i, t, s, "h", "t", "n", "b") for i, t, s in rows], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
