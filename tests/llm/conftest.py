import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys and texts, empty, very long and repeated rows, ties, and columns with names that operators use."""
    rows = [
        (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, None), (4, ""), (None, "a b c d e f g h i j"), (None, None), (5, LONG), (6, LONG + " end"),
        (7, "short"), (8, "SHORT"), (9, " \n\t "), (9, " \n\t "), (10, "é ü 日本 token = 'abcdef123' \n\n x"), (10, "other text under the same key, of more than five words"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["id", "k", "t", "h", "s", "size", "shard", "slot", "score", "spans", "n_spans", "piece", "length", "b", "n", "sig", "removed", "lines", "component_id", "kept", "n_removed", "salt", "n_lines", "__h"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def docs_of(sf="sf0.001"):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/{sf}/documents.parquet' ORDER BY doc_id").fetchall()
