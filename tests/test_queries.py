import datetime
import glob
import os

import duckdb
import pytest

import sightline.queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, SF)
    rows = plain(got.collect(), got.columns)
    assert rows or name == "filter_points_coverage"
    if sql := Q.oracle_sql().get(name):
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        want = plain(want.fetchall(), names)
        assert len(rows) == len(want)
        for a, b in zip(rows, want):
            assert all(abs(x - y) < 2e-5 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_opposite_headings_weigh_as_in_sql(spark, tmp_path):
    # A frame a pair, one after the other by confidence: opposite headings at every degree, then equal ones.
    rows = []
    for i in range(720):
        k, turn = i // 2, 180 * (1 - i % 2)
        day = datetime.datetime(2000, 1, 1) + datetime.timedelta(days=i)
        for line, part in ((1, k + turn), (2, k)):
            rows.append((i, part, 1, line, 10.0, 100000.0 - i, 0.05, 0.02, "A", day))
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for side, name in (("est", "be"), ("gt", "bg")):
        got = Q.S.boxes(spark, str(tmp_path), side).select("frame", "yaw").collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(f"WITH {Q.BOX} SELECT frame, yaw FROM {name}").fetchall())
    got = Q.queries()["average_precision_heading"](spark, str(tmp_path)).collect()
    want = con.execute(Q.oracle_sql()["average_precision_heading"]).fetchall()
    assert {r["class"]: (r["value"], r["support"]) for r in got} == {c: (pytest.approx(v, abs=1e-6), n) for c, v, n in want}
