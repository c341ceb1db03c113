"""The registered corpus queries, on the small tables, against their SQL; those without SQL against their operators."""

import math

import duckdb
import pytest

from eventloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(queries.oracle_sql()[name])
    at = [c[0] for c in want.description]
    assert sorted(at) == columns
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows_and_columns(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = queries.queries()[name](spark, SF)
    columns = {
        "op1_simhash": {"doc_id", "fingerprint", "component_id"},
        "op2_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op4_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op10_language": {"doc_id", "held_out", "lang_pred", "score"},
    }[name]
    rows = found.collect()
    assert columns <= set(found.columns) and len({r["doc_id"] for r in rows}) == n and (len(rows) == n or name == "op4_packing")


def test_null_turns_come_first_in_sql_too(spark, tmp_path):
    rows = [(1, None, "user", "a"), (1, 0, "assistant", "b"), (1, None, "assistant", "c"), (2, 1, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP6_SQL)
    names = [c[0] for c in want.description]
    got = queries.op6_chat(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
