"""Rules of lines against their SQL, over blanks and line ends of all kinds."""

from __future__ import annotations

import random

import duckdb

from __spark_entry__ import oracle_sql, queries

SIGNS = [*".!?:\"'-*•#1)a \n\r\t\x0b\x0c\x1c\x85\xa0\u2003\u2028\u2029\u3000\u200b\ufeff", "1.", "- ", ".\n", ".\r", "a\x0bb "]


def test_lines_equal_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(SIGNS, k=rng.randrange(8)))) for i in range(4000)] + [(-1, None), (-2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("plain_prose", "heading_lines"):
        want = dict(con.sql(oracle_sql()[name]).fetchall())
        got = {r[0]: r[1] for r in queries()[name](spark, str(tmp_path)).collect()}
        assert {k: (rows[k], got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
        assert got.keys() == want.keys()
