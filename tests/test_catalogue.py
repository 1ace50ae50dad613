"""Every registered query of this library's own against its SQL, on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: "" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, data, con):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(df.select(*columns).collect()) == plain(con.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
