import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """All documents of the smallest table: (doc_id, text)."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, very long, repeated and special texts, repeated and null ids, and columns whose names clash with those used inside."""
    long = "Lorem ipsum dolor, " * 20000
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None), (5, long), (6, "ONE two Three"), (7, "日本語 text ﬁne “quoted” ½ İstanbul ΣΑΣ"), (8, "x <|endoftext|> y <|startoftext|> 'll 's"), (9, "\x00 nul \x1c sep"), (5, "other text under an id that is taken")]
    out = [(i, t, None if k % 2 else "en", None if k % 3 else "src0", None if k % 2 else len(t or ""), 1.0, b"x", 2, "w", "g", "h", "f", "r", "c") for k, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, node binary, label int, words string, gaps string, hits string, findings string, row string, k0 string"
    return spark.createDataFrame(out, names)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, None, 1), (4, 1, 0), (4, 1, 1), (6, 0, None), (None, 1, 1), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
