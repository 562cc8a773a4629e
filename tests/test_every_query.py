"""Every registered query of the engine's own operators runs, and gives the columns its SQL gives."""

import duckdb
import pytest

from vistaframe.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, duck, name):
    found = queries.QUERIES[name](spark, SMALL)
    rows = found.collect()
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name])
        assert sorted(found.columns) == sorted(c[0] for c in want.description)
        assert len(rows) == len(want.fetchall())
