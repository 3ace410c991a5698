import duckdb
import pytest

from tests.test_queries import TABLES


@pytest.fixture(scope="module")
def con_llm(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection
