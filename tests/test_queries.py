"""Every query with SQL of its own against DuckDB, and properties of the others."""

import os

import duckdb
import pytest

from twinarm.plans import queries as main

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    f = frame[columns].astype(object)
    return sorted(map(repr, f.where(f.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(main.SQL))
def test_against_sql(spark, con, name):
    want, got = con.execute(main.SQL[name]).df(), main.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(main.QUERIES) - set(main.SQL)))
def test_rows(spark, name):
    df = main.QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_colours_of_a_pair_do_not_overlap(spark):
    got = main.QUERIES["ng_first_fit"](spark, SF).toPandas()
    for _, g in got.groupby(["l_gene", "r_gene", "ng"]):
        held = sorted(zip(g.ext_min, g.ext_max))
        assert all(b <= c for (_, b), (c, _) in zip(held, held[1:]))
