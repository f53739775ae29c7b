import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source); an extra column has the name of an output column."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(3)
        if extra:
            for name in ("n_bytes", "key", "shard", "size", "kept", "text_hash", "n", "rk", "of", "of_rk", "hash", "lost_id", "lost_rk", "dropped", "removed", "keeper", "lines", "same", "node", "sig", "lo", "hi", "found", "anchor", "target", "_rk", "_text", "_id"):
                df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


ODD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\nc"), (5, "x   y <|endoftext|> z's"), (6, "\n"), (7, "日本 語　x y"),
    (8, "same text"), (9, "same text"), (9, "same text"), (None, "no id"), (10, "word " * 40000), (11, "a" * 5000), (12, "t\tu\r\nv \x1c w"),
]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
