import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["double_arrow", "all_arrow", "perm_precedence", "caveat_true_false_missing", "write_touch_create_delete", "public_and_public_subjects", "arrow_parent_caveat", "caveat_macros", "integrity_verify", "export_partitioned"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    r = c.sql(entry.oracle_sql()[name])
    want = sorted(str([dict(zip(r.columns, x, strict=True))[n] for n in names]) for x in r.fetchall())
    assert sorted(str(list(x)) for x in df.select(*names).collect()) == want


def test_oracles_have_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
