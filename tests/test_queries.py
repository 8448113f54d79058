"""Every query that isn't of the llm package against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR

NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, tmp_path, name):
    path = str(tmp_path / "out")
    entry.queries()[name](spark, SF_DIR).write.parquet(path)
    if name not in entry.oracle_sql():
        assert os.path.isdir(path)
        return
    duck.execute(f"CREATE OR REPLACE VIEW own AS SELECT * FROM '{path}/*.parquet'")
    duck.execute("CREATE OR REPLACE TABLE oracle AS " + entry.oracle_sql()[name])
    own, oracle = (sorted(c[0] for c in duck.execute(f"DESCRIBE {t}").fetchall()) for t in ("own", "oracle"))
    assert own == oracle
    cols = ", ".join(f'"{c}"' for c in own)
    counts = [duck.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("own", "oracle")]
    assert counts[0] == counts[1]
    assert duck.execute(f"SELECT {cols} FROM own EXCEPT ALL SELECT {cols} FROM oracle").fetchall() == []
