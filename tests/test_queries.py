import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

from weft import queries as q  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return c


# test_sparse reads each format back from its arrays
@pytest.mark.parametrize("name", sorted(n for n in q.oracle_sql() if not n.startswith("roundtrip_")))
def test_against_sql(spark, db, name):
    a, b = q.queries()[name](spark, DATA).toPandas(), db.sql(q.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and all((a[c].to_numpy() == b[c].to_numpy()).all() for c in cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_schedule_is_balanced(spark):
    r = q.queries()["cisr_schedule"](spark, DATA)
    loads = [x[1] for x in r.groupBy("bucket").sum("nnz").collect()]
    assert max(loads) - min(loads) <= r.agg({"nnz": "max"}).first()[0]


def test_every_row_is_reduced(spark, db):
    got = q.queries()["reduce_sum"](spark, DATA)
    assert got.count() == db.sql("select count(distinct l_orderkey) from lineitem").fetchall()[0][0]
    assert got.agg({"x": "sum"}).first()[0] == db.sql("select sum(l_linenumber) from lineitem").fetchall()[0][0]
    x = q.queries()["spmv_dense_out"](spark, DATA)
    assert x.where("x <> 0").count() == db.sql("select count(distinct l_suppkey) from lineitem").fetchall()[0][0] == q.queries()["dcsr_ptr"](spark, DATA).count() - 1


def test_diagonals_follow_the_keys(spark, db):
    n, diagonals = db.sql("select count(distinct (l_suppkey, l_partkey)), count(distinct l_partkey - l_suppkey) from lineitem").fetchall()[0]
    d = q.queries()["dia_diagonals"](spark, DATA)
    assert d.count() == diagonals > 127 and d.agg({"n": "sum"}).first()[0] == n
