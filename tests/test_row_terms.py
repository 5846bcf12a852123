"""Queries over the terms of all rows beside their SQL, over tables whose null bags DuckDB fills by the tokenizer's SQL."""

import pytest

from faultloom.plans import log_queries as L

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


def filled(table, row_id):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw AS SELECT * RENAME ({row_id} AS id) FROM read_parquet('{SF}/{table}.parquet')")
    con.execute(f"CREATE TABLE made AS SELECT id, map_from_entries(list((term, n))) AS made FROM ({L.TERMS_SQL.replace('FROM analyses', 'FROM raw')}) GROUP BY 1")
    con.execute("CREATE TABLE filled AS SELECT raw.* REPLACE (coalesce(tokens, made) AS tokens) FROM raw LEFT JOIN made USING (id)")
    assert con.execute("SELECT count(*) FROM raw WHERE tokens IS NULL").fetchone()[0] > 0
    con.execute("CREATE VIEW analyses AS FROM filled")
    con.execute("CREATE VIEW incoming AS SELECT * RENAME (id AS record_id) FROM filled")
    return con


def same(con, sql, df):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want, got = sorted(map(tuple, cur.fetchall()), key=repr), sorted(map(tuple, df.select(names).collect()), key=repr)
    assert got == want and got


def test_clusters_of_the_history(spark):
    con = filled("analyses", "id")
    for name, sql in (("history_pairs", "cosine_pairs"), ("history_cluster_members", "cluster_members"), ("history_clusters", "failure_clusters")):
        same(con, L.ORACLE[sql], L.QUERIES[name](spark, SF))


def test_clusters_of_records_without_stored_terms(spark):
    con = filled("incoming", "record_id")
    for name in ("cosine_pairs", "cluster_members", "failure_clusters"):
        same(con, L.ORACLE[name], L.QUERIES[name](spark, SF))


def test_search_and_idf_of_rows_without_stored_terms(spark):
    con = filled("analyses", "id")
    for name in ("idf_terms", "tfidf_top"):
        same(con, L.ORACLE[name], L.QUERIES[name](spark, SF))
