import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session

    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def oracle():
    """Rows of a SQL text over a folder's tables, as tuples in the order of the sorted names."""
    import duckdb

    def run(sql, folder=SMALL):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        at = [names.index(n) for n in sorted(names)]
        kinds = {d[0]: str(d[1]) for d in found.description}
        return sorted(names), kinds, [tuple(r[i] for i in at) for r in found.fetchall()]

    return run


def rows_of(df):
    names = sorted(df.columns)
    return names, [tuple(r[n] for n in names) for r in df.collect()]


def alike(rows):
    """Rows in an order of their own, floats rounded to what sums in any order agree on."""
    return sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)
