"""The registered queries: one row per document or page, and equality with SQL where there is any."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from dayloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
ONE_ROW_EACH = {"op1_main_text": "pages"} | dict.fromkeys(
    ("op2_pii", "op3_secrets", "op4_quality", "op6_sharding", "op7_token_counts", "op8_fingerprints", "op9_jaccard_join", "op13_minhash"),
    "documents")


def test_all_and_the_pipeline_are_registered():
    names = set(entry_points.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_each(spark, name):
    table = spark.read.parquet(f"{FOLDER}/{ONE_ROW_EACH[name]}.parquet")
    key = "page_id" if name == "op1_main_text" else "doc_id"
    got = [r[0] for r in queries.QUERIES[name](spark, FOLDER).select(key).collect()]
    assert sorted(got) == sorted(r[0] for r in table.select(key).collect())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equal_to_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = connection.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    expected = sorted(found.fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, FOLDER).select(*columns).collect())
    assert got == expected and got
