"""Every registered query beside its SQL on the smallest tables; the contract of the entry module."""

import pathlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in pathlib.Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == cols
    assert ours == Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["alias_id", "root_id", "depth", "path"]
