import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """documents of (doc_id, text) rows; extra adds columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS)
    if extra:
        for name in ("node", "n", "token", "row", "start", "kind", "label", "spans", "doc", "g", "w", "score", "word", "toxic", "base"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and id-less rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, "an id is missing here today"), (4, "same words in this row"), (4, "same words in this row"), (5, "same words in this row"), (6, "one"), (7, "mail a@b.co password=hunter22 " * 6000), (8, "ünï 🎉 çode " * 50)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows, extra=True)
