"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import os
import subprocess
import sys

import duckdb
import pytest

from fathomline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime.datetime)):
        return str(value)
    return str(int(value)) if float(value).is_integer() else f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in frame.collect())
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in result.fetchall())
    assert got == want


def test_entry_has_stable_schema(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "path", "rule_id", "surface", "classification", "secondary", "teaching"]


def test_entry_without_a_library_of_the_subpackage():
    """A module that the training-data operators need and that is not there costs only their queries."""
    blocked = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert e.MISSING == 'zstandard'; assert len(e.queries()) > 100 and not any(q.startswith('op1') for q in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", blocked], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
