import pytest

#: Nulls, empty and blank texts, ties, repeated rows and ids, and a long text.
LONG = "zero " + " ".join(f"w{k % 997} t{k}" for k in range(6000))
ODD = [
    (1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "one two"), (6, "Same text here, again. And more of it\nthan one line."), (7, "Same text here, again. And more of it\nthan one line."),
    (7, "Same text here, again. And more of it\nthan one line."), (None, "no id at all"), (None, None), (8, LONG), (9, LONG), (10, "ünïcode — “quotes” 日本語 \x00 \u2028 end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ODD], "doc_id long, text string, id string, n int, runs string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The smallest documents table, as rows."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
