"""Queries do the whole job: all ids, through the operators themselves."""

import duckdb

import __spark_entry__ as entry
from permspark import queries

DIR = "/root/testdata/sf0.001"


def both(spark, name):
    c = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = entry.queries()[name](spark, DIR)
    r = c.sql(entry.oracle_sql()[name])
    return sorted(map(tuple, df.select(*r.columns).collect())), sorted(r.fetchall())


def test_usersets_of_all_groups(spark):
    got, want = both(spark, "userset_direct_or_indirect")
    assert got == want and len({a for a, _ in got}) > 25


def test_preconditions_reach_the_operator(spark, monkeypatch):
    got, want = both(spark, "preconditions")
    assert got == want
    monkeypatch.setattr(queries, "check_preconditions", lambda df, p: None)
    assert both(spark, "preconditions")[0] != want


def test_pages_follow_cursors(spark, monkeypatch):
    cursors, real = [], queries.Engine.lookup_resources_page

    def spy(self, *a, cursor=None, **o):
        cursors.append(cursor)
        return real(self, *a, cursor=cursor, **o)

    monkeypatch.setattr(queries.Engine, "lookup_resources_page", spy)
    got, want = both(spark, "lookup_resources_paged")
    assert got == want and len(got) == 100
    assert cursors[0] is None and all(cursors[1:]) and len(cursors) == 4
