"""Every query of the subpackage runs at the smallest size; those with SQL give its rows."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from spanloom import runtime
from spanloom.llm.queries import R

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def rows(df, cols):
    return sorted(repr(tuple(map(norm, r))) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, duck, name):
    df = R.queries[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df, cols)
    if name in R.sql:
        r = duck.execute(R.sql[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in r.fetchall())


def test_staged_tables_go_to_the_shared_folder_and_are_deleted(spark):
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    root = Path(runtime.shared_dir(spark).removeprefix("file://")) / "spanloom"
    other = root / "another-application"
    other.mkdir(parents=True)
    assert R.queries["p3_found"](spark, SF).count() >= 0
    own = root / spark.sparkContext.applicationId
    assert list(own.iterdir())
    runtime.purge(spark)
    assert not own.exists() and other.exists()
