import pytest

DOCS = "doc_id long, text string, source string, n_words string, _quality string"


@pytest.fixture
def make(spark):
    """A frame of documents; two columns have names that operators use for their results."""

    def of(rows, schema=DOCS):
        names = schema.split(", ")
        full = [tuple(r) + (None,) * (len(names) - len(r)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return of


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture
def hostile(make):
    """Nulls, empty and wordless texts, one very long text, repeated rows, a repeated doc_id."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [(None, "a b c d e f", "s"), (1, None, "s"), (2, "", None), (3, " \t\n ", "s"), (4, "one two", "t"), (4, "one two", "t"), (4, "other text here", "t"), (5, long, "u"), (None, None, None)]
    return make(rows), rows


@pytest.fixture
def by_id():
    return lambda df, *cols: {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}
