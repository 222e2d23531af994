"""Every registered query of the analyses against its statement in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from stratalens.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_flagship(spark):
    found = {(r["key_name"], r["feature"]): r["holds"] for r in catalogue.flagship(spark, FOLDER).collect()}
    assert found["nation", "n_name"] and found["order", "o_orderstatus"] and not found["region", "n_name"]


def test_nothing_else_needs_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['stratalens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
