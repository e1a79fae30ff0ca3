"""Each query of the catalog against its SQL on the smallest tables."""

import duckdb
import pytest

from weftgraph.plans import load_catalog

CATALOG = load_catalog()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return (v + 0.0 if v else 0.0) if isinstance(v, float) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(CATALOG.ORACLES))
def test_equal(spark, duck, name):
    df = CATALOG.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr(tuple(map(plain, r))) for r in duck.sql(f"SELECT {names} FROM ({CATALOG.ORACLES[name]}) q").fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["spectral_hist", "link_split", "sgc_lr", "token_generator", "rowtree_generator", "trial_benchmark"])
def test_rows(spark, name):
    assert CATALOG.QUERIES[name](spark, DATA).count() > 0
