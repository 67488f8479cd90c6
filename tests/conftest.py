import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from seqloom.tables import session

    s = session("local[4]", 4, spark_sql_files_openCostInBytes="1m")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "documents benchmark conversations pages labels nation".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect()), cols


def sql_rows(duck, sql):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall()), sorted(names)


def _cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)
