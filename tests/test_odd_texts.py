"""Queries against their SQL on texts that the given tables don't hold."""

import duckdb

from tiltfield.plans import ORACLE_SQL, QUERIES

TEXTS = [None, "", " ", ". ", "12 of 3.", "The cat. A dog sat!", "of the", "see https://a.b/c the end"]


def test_token_keep_without_text(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["token_keep"](spark, str(tmp_path)).select("doc_id", "lemmas").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select doc_id, lemmas from ({ORACLE_SQL['token_keep']})").fetchall())
    assert got == want and len(got) == 6  # nothing of a null or empty text
