"""Queries of this package that SQL can express, against it."""

import duckdb
import pytest

from fernweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, tmp_path, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries.queries()[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE VIEW own AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.execute("CREATE TABLE oracle AS " + queries.oracle_sql()[name])
    cols = ", ".join(c[0] for c in con.execute("DESCRIBE own").fetchall())
    assert con.execute("SELECT count(*) FROM own").fetchall() == con.execute("SELECT count(*) FROM oracle").fetchall()
    assert con.execute(f"SELECT {cols} FROM own EXCEPT ALL SELECT {cols} FROM oracle").fetchall() == []
