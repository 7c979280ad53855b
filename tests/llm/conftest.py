import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture()
def docs(spark):
    """Builds documents from (doc_id, text, source), with columns that clash with helpers' names."""

    def build(rows):
        full = [(i, text, "en", source, len(text or ""), "x", 1, "y") for i, text, source in rows]
        schema = SCHEMA + ", row string, size int, node string"
        return spark.createDataFrame(full, schema).repartition(3)

    return build
