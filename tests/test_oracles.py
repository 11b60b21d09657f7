"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.execute(SQL[name])
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == cols
    want = sorted(tuple(cell(row[theirs.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


#: Order-dependent groupings and an edit distance that SQL counts in bytes; test_groups.py and test_clones.py have them.
WITHOUT = {"found_communities", "clone_cliques", "clone_centroids", "text_similarity", "community_merged"}


def test_every_query_has_sql():
    assert set(registry.queries()) - set(SQL) == WITHOUT


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_the_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
