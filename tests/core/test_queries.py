import math

import duckdb
import pytest

from keyloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cur = c.execute(queries.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(str(plain(x)) for x in r) for r in cur.fetchall())
    got = sorted(tuple(str(plain(x)) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
