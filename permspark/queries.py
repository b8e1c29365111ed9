"""The engine's queries over the driver's tables, each with SQL that gives the same rows.

Edges are derived from the TPC-H-like tables; ids are strings, times fixed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.operators.engine import Engine
from permspark.operators.reads import KEY, Filter, SubjectSelector, changes, complete, fold, read, snapshot
from permspark.operators.writes import HISTORY, Store, WriteError, apply_updates, check_preconditions, delete_matching, statistics, violations
from permspark.plans.dsl import parse
from permspark.plans.materialize import work_dir
from permspark.plans.schema import computable, dependents, diff, entrypoints, load, reflect
from permspark.sources.tables import sign, verify
from permspark.sources.text import format_column, parse_lines, read_text, write_text
from permspark.streaming.watch import EVENT, stream, watch

AS_OF = "1998-01-01 00:00:00"
SCHEMA = """
use expiration
use self

caveat limit(amount double, max double) { amount <= max }
caveat listed(sizes list<int>, least int) { sizes.all(i, i >= least) }
caveat tagged(tags map<any>, key string) { key in tags && tags[key] == 1 }
caveat opens(at timestamp, now timestamp) { now >= at }
caveat from_net(address ipaddress, cidr string) { address.in_cidr(cidr) }

definition user {}
definition region {}
definition nation {
  relation region: region
  permission region_of = region
}
definition supplier {
  relation home: nation
  permission home_in = home
  permission based_in = home->region_of
}
definition part {
  relation supplier: supplier
  permission from_region = supplier->based_in
}
definition customer {
  relation home: nation
  permission home_in = home
  permission lives_in = home->region_of
}
definition order {
  relation owner: customer
  relation watcher: customer
  relation auditor: customer
  relation placed_by: customer | supplier
  relation supplier: supplier
  relation discount_viewer: customer with limit
  relation size_viewer: customer with listed
  relation tag_viewer: customer with tagged
  relation time_viewer: customer with opens
  relation net_viewer: customer with from_net
  relation temp_viewer: customer with expiration
  permission seen = owner + watcher
  permission both = owner & watcher
  permission quiet = owner - watcher
  permission ordered = owner - watcher + auditor
  permission nobody = nil
  permission nobody_else = owner + nil
  permission reach = supplier->based_in
  permission any_region = supplier.any(based_in)
  permission only_region = supplier.all(based_in)
  permission origin = placed_by->home_in
  permission capped = discount_viewer & owner
  permission temporary = temp_viewer
}
definition thing {
  relation owner: customer
  permission itself = self
  permission held = owner + self
}
definition group {
  relation member: customer | group#member
}
definition ring {
  relation member: customer | ring#member
}
definition folder {
  relation parent: folder
  relation viewer: customer
  permission view = viewer + parent->view
}
definition doc {
  relation viewer: user | user:*
  relation banned: user
  relation forgiven: user
  relation reader: user
  permission view = viewer - banned
  permission nested = viewer - (banned - forgiven)
  permission read = viewer & reader
  permission all_of = viewer + reader
}
"""

S = "CAST({} AS VARCHAR)".format
#: name: (resource type, id, relation, subject type, id, subject relation, rest of the SELECT) for DuckDB.
EDGES = {
    "owner": f"SELECT 'order' rt, {S('o_orderkey')} rid, 'owner' rel, 'customer' st, {S('o_custkey')} sid, '...' sr FROM orders",
    "watcher": f"SELECT 'order' rt, {S('o_orderkey')} rid, 'watcher' rel, 'customer' st, {S('o_custkey')} sid, '...' sr FROM orders WHERE o_orderstatus = 'F'",
    "auditor": f"SELECT 'order' rt, {S('o_orderkey')} rid, 'auditor' rel, 'customer' st, {S('o_custkey + 1')} sid, '...' sr FROM orders WHERE o_orderstatus = 'O'",
    "supplier": f"SELECT DISTINCT 'order' rt, {S('l_orderkey')} rid, 'supplier' rel, 'supplier' st, {S('l_suppkey')} sid, '...' sr FROM lineitem",
    "part_supplier": f"SELECT DISTINCT 'part' rt, {S('l_partkey')} rid, 'supplier' rel, 'supplier' st, {S('l_suppkey')} sid, '...' sr FROM lineitem",
    "supplier_home": f"SELECT 'supplier' rt, {S('s_suppkey')} rid, 'home' rel, 'nation' st, {S('s_nationkey')} sid, '...' sr FROM supplier",
    "customer_home": f"SELECT 'customer' rt, {S('c_custkey')} rid, 'home' rel, 'nation' st, {S('c_nationkey')} sid, '...' sr FROM customer",
    "nation_region": f"SELECT 'nation' rt, {S('n_nationkey')} rid, 'region' rel, 'region' st, {S('n_regionkey')} sid, '...' sr FROM nation",
    "placed_customer": f"SELECT 'order' rt, {S('o_orderkey')} rid, 'placed_by' rel, 'customer' st, {S('o_custkey')} sid, '...' sr FROM orders",
    "placed_supplier": f"SELECT DISTINCT 'order' rt, {S('l_orderkey')} rid, 'placed_by' rel, 'supplier' st, {S('l_suppkey')} sid, '...' sr FROM lineitem WHERE l_linenumber = 1",
    "thing_owner": f"SELECT 'thing' rt, {S('c_custkey')} rid, 'owner' rel, 'customer' st, {S('c_custkey')} sid, '...' sr FROM customer",
    "group_tree": f"SELECT 'group' rt, {S('c_custkey // 2')} rid, 'member' rel, 'group' st, {S('c_custkey')} sid, 'member' sr FROM customer",
    "group_leaf": f"SELECT 'group' rt, {S('c_custkey')} rid, 'member' rel, 'customer' st, {S('c_custkey')} sid, '...' sr FROM customer",
    "ring_tree": f"SELECT 'ring' rt, {S('c_custkey // 2')} rid, 'member' rel, 'ring' st, {S('c_custkey')} sid, 'member' sr FROM customer",
    "ring_leaf": f"SELECT 'ring' rt, {S('c_custkey')} rid, 'member' rel, 'customer' st, {S('c_custkey')} sid, '...' sr FROM customer",
    "ring_close": f"SELECT 'ring' rt, {S('max(c_custkey)')} rid, 'member' rel, 'ring' st, '1' sid, 'member' sr FROM customer",
    "folder_parent": f"SELECT 'folder' rt, {S('c_custkey')} rid, 'parent' rel, 'folder' st, {S('c_custkey // 2')} sid, '...' sr FROM customer",
    "folder_viewer": f"SELECT 'folder' rt, {S('c_custkey')} rid, 'viewer' rel, 'customer' st, {S('c_custkey')} sid, '...' sr FROM customer",
    "doc_public": f"SELECT 'doc' rt, {S('doc_id')} rid, 'viewer' rel, 'user' st, '*' sid, '...' sr FROM documents WHERE lang = 'en'",
    "doc_viewer": f"SELECT 'doc' rt, {S('doc_id')} rid, 'viewer' rel, 'user' st, {S('doc_id % 50')} sid, '...' sr FROM documents WHERE lang <> 'en'",
    "doc_banned": f"SELECT 'doc' rt, {S('doc_id')} rid, 'banned' rel, 'user' st, {S('doc_id % 7')} sid, '...' sr FROM documents",
    "doc_forgiven": f"SELECT 'doc' rt, {S('doc_id')} rid, 'forgiven' rel, 'user' st, {S('doc_id % 3')} sid, '...' sr FROM documents",
    "doc_reader": f"SELECT 'doc' rt, {S('doc_id')} rid, 'reader' rel, 'user' st, {S('doc_id % 11')} sid, '...' sr FROM documents",
}


def spark_edges(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The union of the named edges, with Spark's spelling of the same SQL."""
    out = None
    for n in names:
        sql = EDGES[n].replace("VARCHAR", "STRING").replace("//", "div")
        table = sql.split("FROM ")[1].split()[0]
        spark.read.parquet(f"{d}/{table}.parquet").createOrReplaceTempView(f"_ps_{table}")
        df = spark.sql(sql.replace(f"FROM {table}", f"FROM _ps_{table}")).toDF("resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation")
        out = df if out is None else out.unionByName(df)
    return complete(out)


def _sql(*names: str) -> str:
    return " UNION ALL ".join(EDGES[n] for n in names)


def _engine(spark: SparkSession, d: str, *names: str, **more) -> Engine:
    return Engine(load(SCHEMA), spark_edges(spark, d, *names), **more)


def _members(type_: str, permission: str, subject: str, *names: str, relation: str = "..."):
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = _engine(spark, d, *names).members(type_, permission, subject, relation)
        return m.select(F.col("resource").alias("resource_id"), F.col("subject").alias("subject_id"))

    return run


def _pairs(sql: str) -> str:
    return f"SELECT DISTINCT a AS resource_id, b AS subject_id FROM ({sql})"


def _rel(name: str) -> str:
    return f"SELECT rid AS a, sid AS b FROM ({EDGES[name]})"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


_KEYS_SQL = "rt AS resource_type, rid AS resource_id, rel AS relation, st AS subject_type, sid AS subject_id, sr AS subject_relation"


def _read(f: Filter, where: str, *names: str) -> tuple:
    return (lambda spark, d: read(spark_edges(spark, d, *names), f).select(*KEY)), f"SELECT {_KEYS_SQL} FROM ({_sql(*names)}) WHERE {where}"


_MANY = ("owner", "watcher", "group_tree", "doc_public", "doc_viewer")
_add("read_relationships", *_read(Filter(type="order", relation="watcher"), "rt = 'order' AND rel = 'watcher'", *_MANY))
_add("read_prefix", *_read(Filter(type="order", prefix="12"), "rt = 'order' AND rid LIKE '12%'", *_MANY))
_add("read_subject_filter", *_read(Filter(subjects=(SubjectSelector("group", relations=("non-ellipsis",)), SubjectSelector("user", ids=("*",)))), "(st = 'group' AND sr <> '...') OR (st = 'user' AND sid = '*')", *_MANY))
_add("reverse_scan", *_read(Filter(subjects=(SubjectSelector("customer", relations=("...",)),)), "st = 'customer' AND sr = '...'", *_MANY))

_add("perm_union", _members("order", "seen", "customer", "owner", "watcher"), _pairs(f"{_rel('owner')} UNION {_rel('watcher')}"))
_add("perm_intersection", _members("order", "both", "customer", "owner", "watcher"), _pairs(f"{_rel('owner')} INTERSECT {_rel('watcher')}"))
_add("perm_exclusion", _members("order", "quiet", "customer", "owner", "watcher"), _pairs(f"{_rel('owner')} EXCEPT {_rel('watcher')}"))
_add("perm_precedence", _members("order", "ordered", "customer", "owner", "watcher", "auditor"), _pairs(f"{_rel('owner')} EXCEPT ({_rel('watcher')} UNION {_rel('auditor')})"))
_add("perm_nil", _members("order", "nobody_else", "customer", "owner"), _pairs(_rel("owner")))
_add("perm_self", _members("thing", "itself", "thing", "thing_owner"), "SELECT DISTINCT rid AS resource_id, rid AS subject_id FROM (" + EDGES["thing_owner"] + ")")
_add("perm_computed", _members("nation", "region_of", "region", "nation_region"), _pairs(_rel("nation_region")))

_HOP = f"SELECT x.rid AS a, z.sid AS b FROM ({{}}) x JOIN ({EDGES['supplier_home']}) y ON x.sid = y.rid JOIN ({EDGES['nation_region']}) z ON y.sid = z.rid"
_add("arrow", _members("supplier", "based_in", "region", "supplier_home", "nation_region"), _pairs(f"SELECT y.rid AS a, z.sid AS b FROM ({EDGES['supplier_home']}) y JOIN ({EDGES['nation_region']}) z ON y.sid = z.rid"))
_add("double_arrow", _members("part", "from_region", "region", "part_supplier", "supplier_home", "nation_region"), _pairs(_HOP.format(EDGES["part_supplier"])))
_add("any_arrow", _members("order", "any_region", "region", "supplier", "supplier_home", "nation_region"), _pairs(_HOP.format(EDGES["supplier"])))
_add(
    "all_arrow",
    _members("order", "only_region", "region", "supplier", "supplier_home", "nation_region"),
    f"WITH h AS ({_HOP.format(EDGES['supplier'])}), p AS (SELECT DISTINCT a, b FROM h) SELECT a AS resource_id, b AS subject_id FROM p "
    f"WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.a AND q.b <> p.b)",
)
_add(
    "arrow_multi_type",
    _members("order", "origin", "nation", "placed_customer", "placed_supplier", "customer_home", "supplier_home"),
    _pairs(
        f"SELECT x.rid AS a, y.sid AS b FROM ({_sql('placed_customer', 'placed_supplier')}) x JOIN ({_sql('customer_home', 'supplier_home')}) y ON x.st = y.rt AND x.sid = y.rid"
    ),
)


def _closure(tree: str, leaf: str, close: str | None = None) -> str:
    links = _sql(*([tree, close] if close else [tree]))
    return (
        f"WITH RECURSIVE e AS ({links}), r(a, b) AS (SELECT rid, rid FROM ({EDGES[leaf]}) UNION SELECT e.rid, r.b FROM r JOIN e ON e.sid = r.a) "
        "SELECT DISTINCT a AS resource_id, b AS subject_id FROM r"
    )


def _lookup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Members of every group that has an edge."""
    groups = spark_edges(spark, d, "group_tree", "group_leaf").select("resource_id").distinct()
    return _engine(spark, d, "group_tree", "group_leaf").lookup_subjects(groups, "group", "member", "customer")


_add("userset_direct_or_indirect", lambda s, d: _lookup_groups(s, d).select("resource_id", "subject_id"), _closure("group_tree", "group_leaf"))
_add("recursive_group", _members("group", "member", "customer", "group_tree", "group_leaf"), _closure("group_tree", "group_leaf"))


def _some_groups(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("resource_id"))


_add("recursive_lookup_subjects", lambda s, d: _engine(s, d, "group_tree", "group_leaf").lookup_subjects(_some_groups(s, d), "group", "member", "customer").select("resource_id", "subject_id"), "SELECT * FROM (" + _closure("group_tree", "group_leaf") + ") WHERE resource_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
_add(
    "recursive_lookup_resources",
    lambda s, d: _engine(s, d, "folder_parent", "folder_viewer").lookup_resources(_some_groups(s, d).withColumnRenamed("resource_id", "subject_id"), "folder", "view", "customer").select("resource_id", "subject_id"),
    f"WITH RECURSIVE e AS ({EDGES['folder_parent']}), r(a, b) AS (SELECT rid, sid FROM ({EDGES['folder_viewer']}) WHERE CAST(sid AS BIGINT) IN (SELECT s_suppkey FROM supplier) UNION SELECT e.rid, r.b FROM r JOIN e ON e.sid = r.a) SELECT DISTINCT a AS resource_id, b AS subject_id FROM r",
)
_add("recursive_cycle", _members("ring", "member", "customer", "ring_tree", "ring_leaf", "ring_close"), _closure("ring_tree", "ring_leaf", "ring_close"))
_add(
    "recursive_parent",
    _members("folder", "view", "customer", "folder_parent", "folder_viewer"),
    f"WITH RECURSIVE e AS ({EDGES['folder_parent']}), r(a, b) AS (SELECT rid, sid FROM ({EDGES['folder_viewer']}) UNION SELECT e.rid, r.b FROM r JOIN e ON e.sid = r.a) SELECT DISTINCT a AS resource_id, b AS subject_id FROM r",
)

_DOCS = ("doc_public", "doc_viewer", "doc_banned", "doc_forgiven", "doc_reader")
_STATE_SQL = "CASE WHEN {} THEN 'HAS' ELSE 'NO' END AS permissionship"


def _doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("resource_id"), F.explode(F.array(*((F.col("doc_id") % k).cast("string") for k in (7, 50)))).alias("subject_id")).distinct()


_DOC_SQL = "WITH p AS (SELECT DISTINCT doc_id, lang, CAST(u AS VARCHAR) AS u FROM (SELECT doc_id, lang, unnest([doc_id % 7, doc_id % 50]) AS u FROM documents)), q AS (SELECT *, (lang = 'en' OR u = CAST(doc_id % 50 AS VARCHAR)) AS v, u = CAST(doc_id % 7 AS VARCHAR) AS b, u = CAST(doc_id % 3 AS VARCHAR) AS f, u = CAST(doc_id % 11 AS VARCHAR) AS r FROM p) SELECT CAST(doc_id AS VARCHAR) AS resource_id, u AS subject_id, " + _STATE_SQL + " FROM q"
for _name, _perm, _cond in (("wildcard_check", "viewer", "v"), ("wildcard_minus_banned", "view", "v AND NOT b"), ("nested_wildcard_exclusion", "nested", "v AND NOT (b AND NOT f)"), ("wildcard_intersect", "read", "v AND r"), ("wildcard_union", "all_of", "v OR r")):
    _add(_name, lambda s, d, p=_perm: _engine(s, d, *_DOCS).check(_doc_pairs(s, d), "doc", p, "user").select("resource_id", "subject_id", "permissionship"), _DOC_SQL.format(_cond))

_add(
    "lookup_subjects",
    lambda s, d: _engine(s, d, *_DOCS).lookup_subjects(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("resource_id")), "doc", "view", "user").select(
        "resource_id", "subject_id", "permissionship", F.array_join(F.transform("excluded", lambda x: x["subject_id"]), ",").alias("excluded")
    ),
    "SELECT CAST(doc_id AS VARCHAR) AS resource_id, '*' AS subject_id, 'HAS' AS permissionship, CAST(doc_id % 7 AS VARCHAR) AS excluded FROM documents WHERE lang = 'en' "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id % 50 AS VARCHAR), 'HAS', '' FROM documents WHERE lang <> 'en' AND doc_id % 50 <> doc_id % 7",
)
_add(
    "lookup_resources",
    lambda s, d: _engine(s, d, "owner", "watcher").lookup_resources(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("subject_id")), "order", "seen", "customer").select("resource_id", "subject_id", "permissionship"),
    f"SELECT DISTINCT a AS resource_id, b AS subject_id, 'HAS' AS permissionship FROM ({_rel('owner')} UNION {_rel('watcher')})",
)


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 rows of a lookup, in pages of 30 that follow each other's cursors."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("subject_id"))
    e, rows, cursor = _engine(spark, d, "owner", "watcher"), [], None
    while len(rows) < 100 and (cursor or not rows):
        more, cursor = e.lookup_resources_page(customers, "order", "seen", "customer", limit=min(30, 100 - len(rows)), cursor=cursor)
        rows += more
        if not more:
            break
    return spark.createDataFrame([(r.resource_id, r.subject_id) for r in rows], "resource_id string, subject_id string")


_add(
    "lookup_resources_paged",
    _paged,
    f"SELECT DISTINCT a AS resource_id, b AS subject_id FROM ({_rel('owner')} UNION {_rel('watcher')}) ORDER BY 1, 2 LIMIT 100",
)
_add(
    "check_bulk",
    lambda s, d: _engine(s, d, "owner", "watcher").check(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("resource_id"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string").alias("subject_id")), "order", "quiet", "customer").select("ordinal", "resource_id", "subject_id", "permissionship"),
    "SELECT o_orderkey AS ordinal, CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey + o_orderkey % 2 AS VARCHAR) AS subject_id, " + _STATE_SQL.format("o_orderkey % 2 = 0 AND o_orderstatus <> 'F'") + " FROM orders",
)


# --- caveats -----------------------------------------------------------------------


def _caveated(relation: str, caveat: str, context):
    """One caveated edge per order; context: a column, null where nothing is stored."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        o = spark.read.parquet(f"{d}/orders.parquet")
        return complete(o.select(F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit(relation).alias("relation"), F.lit("customer").alias("subject_type"), F.col("o_custkey").cast("string").alias("subject_id"), F.lit(caveat).alias("caveat_name"), context().alias("caveat_context")))

    return run


def _check_caveat(relation: str, caveat: str, context, request: dict, case: str) -> tuple:
    edges = _caveated(relation, caveat, context)

    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("resource_id"), F.col("o_custkey").cast("string").alias("subject_id"))
        out = Engine(load(SCHEMA), edges(spark, d), request).check(pairs, "order", relation, "customer")
        return out.select("resource_id", "subject_id", "permissionship", F.array_join("missing", ",").alias("missing"))

    sql = f"SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS subject_id, x.p AS permissionship, CASE WHEN x.p = 'CONDITIONAL' THEN x.m ELSE '' END AS missing FROM (SELECT *, {case} AS x FROM orders)"
    return run, sql


_add("caveat_true_false_missing", *_check_caveat("discount_viewer", "limit", lambda: F.when(F.col("o_orderstatus") != "P", F.to_json(F.struct(F.floor("o_totalprice").alias("max")))), {"amount": 150000}, "CASE WHEN o_orderstatus = 'P' THEN {'p': 'CONDITIONAL', 'm': 'max'} WHEN 150000 <= floor(o_totalprice) THEN {'p': 'HAS', 'm': ''} ELSE {'p': 'NO', 'm': ''} END"))
_add("caveat_list_all", *_check_caveat("size_viewer", "listed", lambda: F.to_json(F.struct(F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 3).alias("sizes"))), {"least": 1}, "CASE WHEN o_orderkey % 5 >= 1 AND o_orderkey % 3 >= 1 THEN {'p': 'HAS', 'm': ''} ELSE {'p': 'NO', 'm': ''} END"))
_add("caveat_map", *_check_caveat("tag_viewer", "tagged", lambda: F.to_json(F.struct(F.create_map(F.col("o_orderstatus"), F.col("o_orderkey") % 2).alias("tags"))), {"key": "F"}, "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 1 THEN {'p': 'HAS', 'm': ''} ELSE {'p': 'NO', 'm': ''} END"))
_add("caveat_time", *_check_caveat("time_viewer", "opens", lambda: F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))), {"now": "1998-01-01T00:00:00Z"}, "CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' THEN {'p': 'HAS', 'm': ''} ELSE {'p': 'NO', 'm': ''} END"))
_add("in_cidr", *_check_caveat("net_viewer", "from_net", lambda: F.to_json(F.struct(F.concat(F.lit("10."), (F.col("o_orderkey") % 4).cast("string"), F.lit(".0.0/16")).alias("cidr"))), {"address": "10.2.3.4"}, "CASE WHEN o_orderkey % 4 = 2 THEN {'p': 'HAS', 'm': ''} ELSE {'p': 'NO', 'm': ''} END"))


def _check_bad(spark: SparkSession, d: str) -> DataFrame:
    """Contexts that are no JSON, or hold a value of another type, spoil their own answers alone."""
    bad = lambda: F.when(F.col("o_orderkey") % 3 == 0, '{"max": "many"}').when(F.col("o_orderkey") % 3 == 1, "{").otherwise(F.to_json(F.struct(F.floor("o_totalprice").alias("max"))))
    pairs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("resource_id"), F.col("o_custkey").cast("string").alias("subject_id"))
    return Engine(load(SCHEMA), _caveated("discount_viewer", "limit", bad)(spark, d), {"amount": 150000}).check(pairs, "order", "discount_viewer", "customer").select("resource_id", "subject_id", "permissionship")


_add("caveat_errors", _check_bad, "SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS subject_id, CASE WHEN o_orderkey % 3 < 2 THEN 'ERROR' WHEN 150000 <= floor(o_totalprice) THEN 'HAS' ELSE 'NO' END AS permissionship FROM orders")


def _temp(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return complete(o.select(F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("temp_viewer").alias("relation"), F.lit("customer").alias("subject_type"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderdate").alias("expiration")))


_add(
    "expiry_filter",
    lambda s, d: Engine(load(SCHEMA), _temp(s, d), as_of=AS_OF).members("order", "temporary", "customer").select(F.col("resource").alias("resource_id"), F.col("subject").alias("subject_id")),
    f"SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS subject_id FROM orders WHERE o_orderdate > TIMESTAMP '{AS_OF}'",
)
_add(
    "caveat_filter",
    lambda s, d: read(_caveated("discount_viewer", "limit", lambda: F.lit(None).cast("string"))(s, d).unionByName(spark_edges(s, d, "owner")), Filter(type="order", caveat="none")).select(*KEY),
    f"SELECT {_KEYS_SQL} FROM ({EDGES['owner']})",
)


# --- writes, snapshots, changes ------------------------------------------------------


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Owners since revision 1; of orders with status F until revision 5."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("resource_id"), "o_orderstatus")
    return spark_edges(spark, d, "owner").join(o, "resource_id").select(*KEY, "caveat_name", "caveat_context", "expiration", F.lit(1).cast("long").alias("created_rev"), F.when(F.col("o_orderstatus") == "F", 5).cast("long").alias("deleted_rev")).select(*[x.split()[0] for x in HISTORY.split(", ")])


def _written(spark: SparkSession, d: str) -> DataFrame:
    w = spark_edges(spark, d, "watcher").withColumn("operation", F.lit("CREATE"))
    t = spark_edges(spark, d, "owner").join(spark_edges(spark, d, "watcher").select("resource_id"), "resource_id", "left_anti").withColumn("operation", F.when(F.col("resource_id").cast("long") % 2 == 0, "TOUCH").otherwise("DELETE"))
    return apply_updates(_history(spark, d), w.unionByName(t.select(*w.columns)), 6)


_add(
    "write_touch_create_delete",
    lambda s, d: snapshot(_written(s, d)).select(*KEY),
    f"SELECT {_KEYS_SQL} FROM ({EDGES['watcher']}) UNION ALL SELECT {_KEYS_SQL} FROM ({EDGES['owner']}) x WHERE CAST(rid AS BIGINT) % 2 = 0 AND rid NOT IN (SELECT rid FROM ({EDGES['watcher']}))",
)
_add("delete_filtered", lambda s, d: snapshot(delete_matching(_history(s, d), Filter(type="order", prefix="1"), 7)[0]).select(*KEY), f"SELECT {_KEYS_SQL} FROM ({EDGES['owner']}) WHERE rid NOT LIKE '1%' AND rid NOT IN (SELECT rid FROM ({EDGES['watcher']}))")
_add("snapshot_as_of", lambda s, d: snapshot(_history(s, d), 4).select(*KEY), f"SELECT {_KEYS_SQL} FROM ({EDGES['owner']})")
_add("watch_changes", lambda s, d: changes(_history(s, d), 1).select("revision", "operation", *KEY), f"SELECT CAST(5 AS BIGINT) AS revision, 'DELETE' AS operation, {_KEYS_SQL} FROM ({EDGES['owner']}) WHERE rid IN (SELECT rid FROM ({EDGES['watcher']}))")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    key = {"resource_type": "doc", "relation": "viewer", "subject_type": "user", "subject_relation": "..."}
    return e.select((F.col("event_id") % 97).alias("revision"), F.when(F.col("event_type").isin("signup", "purchase"), "TOUCH").otherwise("DELETE").alias("operation"), *(F.lit(v).alias(k) for k, v in key.items()), (F.col("event_id") % 13).cast("string").alias("resource_id"), F.col("user_id").cast("string").alias("subject_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("caveat_name", "string"), ("caveat_context", "string"), ("expiration", "timestamp"))))


_add(
    "watch_fold",
    lambda s, d: fold(_events(s, d)).select("revision", "operation", "resource_id", "subject_id"),
    "SELECT event_id % 97 AS revision, CASE WHEN bool_or(event_type IN ('signup', 'purchase')) THEN 'TOUCH' ELSE 'DELETE' END AS operation, CAST(event_id % 13 AS VARCHAR) AS resource_id, CAST(user_id AS VARCHAR) AS subject_id FROM events GROUP BY event_id % 97, event_id % 13, user_id",
)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """A registered counter over a store that the edges were bulk-loaded into."""
    store = Store(spark, load(SCHEMA))
    store.bulk_load(spark_edges(spark, d, *_MANY))
    store.register_counter("orders", Filter(type="order"))
    return spark.createDataFrame([(store.count("orders"),)], "n long")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The head of a store after a bulk load, a write, a filtered deletion and a compaction."""
    store = Store(spark, load(SCHEMA))
    store.bulk_load(spark_edges(spark, d, "owner"))
    store.write(spark_edges(spark, d, "watcher").withColumn("operation", F.lit("CREATE")))
    store.delete(Filter(type="order", relation="owner", prefix="1"))
    store.compact()
    return Store(spark, path=store.path).at().select(*KEY)


def _watched(spark: SparkSession, d: str) -> DataFrame:
    """Every whole revision of the event stream, as a stream delivers them from one file after the other."""
    folder, columns = f"{work_dir(spark)}/watch-{uuid.uuid4().hex}", [x.split()[0] for x in EVENT.split(", ")]
    end = _events(spark, d).limit(1).withColumns({"revision": F.lit(1 << 40), "operation": F.lit("CHECKPOINT")})
    _events(spark, d).unionByName(end).select(*columns).repartitionByRange(3, "revision").sortWithinPartitions("revision").write.parquet(f"{folder}/in")
    emit = lambda df, top: df.write.mode("overwrite").parquet(f"{folder}/out/upto={top}")
    watch(stream(spark, f"{folder}/in", after=-1), emit, f"{folder}/state").awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{folder}/out").select("revision", "operation", "resource_id", "subject_id")


_add("store_bulk_write_delete", _stored, f"SELECT {_KEYS_SQL} FROM ({EDGES['watcher']}) UNION ALL SELECT {_KEYS_SQL} FROM ({EDGES['owner']}) WHERE rid NOT LIKE '1%'")
_add(
    "watch_stream",
    _watched,
    "SELECT event_id % 97 AS revision, CASE WHEN bool_or(event_type IN ('signup', 'purchase')) THEN 'TOUCH' ELSE 'DELETE' END AS operation, CAST(event_id % 13 AS VARCHAR) AS resource_id, CAST(user_id AS VARCHAR) AS subject_id FROM events GROUP BY event_id % 97, event_id % 13, user_id",
)
_add("count_relationships", _counted, f"SELECT count(*) AS n FROM ({_sql(*_MANY)}) WHERE rt = 'order'")
_add("statistics", lambda s, d: statistics(spark_edges(s, d, *_MANY)), f"SELECT rt AS resource_type, rel AS relation, count(*) AS n_edges FROM ({_sql(*_MANY)}) GROUP BY rt, rel")
_add("export_sorted", lambda s, d: spark_edges(s, d, *_MANY).orderBy(*KEY).select(format_column().alias("line")), f"SELECT rt || ':' || rid || '#' || rel || '@' || st || ':' || sid || CASE WHEN sr <> '...' THEN '#' || sr ELSE '' END AS line FROM ({_sql(*_MANY)})")
_add("import_text", lambda s, d: parse_lines(spark_edges(s, d, *_MANY).select(format_column().alias("value"))).select(*KEY), f"SELECT {_KEYS_SQL} FROM ({_sql(*_MANY)})")
_add(
    "write_validation",
    lambda s, d: violations(load(SCHEMA), spark_edges(s, d, "owner", "doc_public").withColumn("subject_type", F.when(F.col("resource_id").cast("long") % 10 == 0, "nation").otherwise(F.col("subject_type")))).select("resource_type", "resource_id", "reason"),
    f"SELECT rt AS resource_type, rid AS resource_id, 'not allowed' AS reason FROM ({_sql('owner', 'doc_public')}) WHERE CAST(rid AS BIGINT) % 10 = 0",
)


def _holds(edges: DataFrame, kind: str, f: Filter) -> bool:
    try:
        check_preconditions(edges, [(kind, f)])
    except WriteError:
        return False
    return True


def _preconditions(spark: SparkSession, d: str) -> DataFrame:
    """Per relation, whether preconditions hold on its edges and fail on edges that nobody has, and the reverse."""
    edges, rows = spark_edges(spark, d, "owner", "watcher"), []
    for r in ("owner", "watcher"):
        there, absent = Filter(type="order", relation=r), Filter(type="order", ids=("none",), relation=r)
        cases = [("must_match", there, True), ("must_match", absent, False), ("must_not_match", there, False), ("must_not_match", absent, True)]
        rows.append((r, all(_holds(edges, kind, f) == want for kind, f, want in cases)))
    return spark.createDataFrame(rows, "relation string, must_match boolean")


_add(
    "preconditions",
    _preconditions,
    "SELECT 'owner' AS relation, true AS must_match UNION ALL SELECT 'watcher', true",
)


# --- schemas -------------------------------------------------------------------------


def _rows(make, schema: str):
    return lambda spark, d: spark.createDataFrame(make(), schema)


#: What reflection of SCHEMA has to give: kind, definition, name, detail.
REFLECTED = """
caveat|limit|amount|double
caveat|limit|max|double
caveat|listed|sizes|list<int>
caveat|listed|least|int
caveat|tagged|tags|map<any>
caveat|tagged|key|string
caveat|opens|at|timestamp
caveat|opens|now|timestamp
caveat|from_net|address|ipaddress
caveat|from_net|cidr|string
caveat_expression|limit||amount <= max
caveat_expression|listed||sizes.all(i, i >= least)
caveat_expression|tagged||key in tags && tags[key] == 1
caveat_expression|opens||now >= at
caveat_expression|from_net||address.in_cidr(cidr)
definition|user||
definition|region||
definition|nation||
relation|nation|region|region
permission|nation|region_of|region
definition|supplier||
relation|supplier|home|nation
permission|supplier|home_in|home
permission|supplier|based_in|home->region_of
definition|part||
relation|part|supplier|supplier
permission|part|from_region|supplier->based_in
definition|customer||
relation|customer|home|nation
permission|customer|home_in|home
permission|customer|lives_in|home->region_of
definition|order||
relation|order|owner|customer
relation|order|watcher|customer
relation|order|auditor|customer
relation|order|placed_by|customer
relation|order|placed_by|supplier
relation|order|supplier|supplier
relation|order|discount_viewer|customer with limit
relation|order|size_viewer|customer with listed
relation|order|tag_viewer|customer with tagged
relation|order|time_viewer|customer with opens
relation|order|net_viewer|customer with from_net
relation|order|temp_viewer|customer with expiration
permission|order|seen|owner + watcher
permission|order|both|owner & watcher
permission|order|quiet|owner - watcher
permission|order|ordered|owner - watcher + auditor
permission|order|nobody|nil
permission|order|nobody_else|owner + nil
permission|order|reach|supplier->based_in
permission|order|any_region|supplier->based_in
permission|order|only_region|supplier.all(based_in)
permission|order|origin|placed_by->home_in
permission|order|capped|discount_viewer & owner
permission|order|temporary|temp_viewer
definition|thing||
relation|thing|owner|customer
permission|thing|itself|self
permission|thing|held|owner + self
definition|group||
relation|group|member|customer
relation|group|member|group#member
definition|ring||
relation|ring|member|customer
relation|ring|member|ring#member
definition|folder||
relation|folder|parent|folder
relation|folder|viewer|customer
permission|folder|view|viewer + parent->view
definition|doc||
relation|doc|viewer|user
relation|doc|viewer|user:*
relation|doc|banned|user
relation|doc|forgiven|user
relation|doc|reader|user
permission|doc|view|viewer - banned
permission|doc|nested|viewer - (banned - forgiven)
permission|doc|read|viewer & reader
permission|doc|all_of|viewer + reader
"""
_add(
    "reflect_schema",
    _rows(lambda: reflect(load(SCHEMA)), "kind string, definition string, name string, detail string"),
    f"SELECT p[1] AS kind, p[2] AS definition, p[3] AS name, p[4] AS detail FROM (SELECT string_split(unnest(string_split('{REFLECTED.strip()}', chr(10))), '|') AS p)",
)
_add("dependent_relations", _rows(lambda: dependents(load(SCHEMA), ("part", "from_region")), "type string, name string"), "SELECT * FROM (VALUES ('nation', 'region'), ('nation', 'region_of'), ('part', 'supplier'), ('supplier', 'based_in'), ('supplier', 'home')) t(type, name)")
_add("computable_permissions", _rows(lambda: computable(load(SCHEMA), ("nation", "region")), "type string, name string"), "SELECT * FROM (VALUES ('customer', 'lives_in'), ('nation', 'region_of'), ('order', 'any_region'), ('order', 'only_region'), ('order', 'reach'), ('part', 'from_region'), ('supplier', 'based_in')) t(type, name)")
_add("entrypoints", _rows(lambda: entrypoints(load(SCHEMA), ("doc", "view"), ("user", "...")), "kind string, type string, name string, direct boolean"), "SELECT 'relation' AS kind, 'doc' AS type, 'viewer' AS name, false AS direct")
_add("diff_schema", _rows(lambda: diff(parse("definition user {}\ndefinition doc { relation viewer: user }"), parse("definition user {}\ndefinition doc { relation viewer: user | user:*\n permission view = viewer }")), "change string, kind string, definition string, name string, detail string"), "SELECT * FROM (VALUES ('added', 'permission', 'doc', 'view', 'viewer'), ('allowed_type_added', 'relation', 'doc', 'viewer', 'user:*')) t(change, kind, definition, name, detail)")


def _expand(spark: SparkSession, d: str) -> DataFrame:
    tree = _engine(spark, d, "owner", "watcher", "auditor").expand("order:1", "ordered")

    def flat(t: dict, path: str):
        if "leaf" in t:
            yield (path, t["leaf"], ",".join(t["subjects"]))
        for i, c in enumerate(t.get("children", ())):
            yield from flat(c, f"{path}/{t['operation']}{i}")

    return spark.createDataFrame(list(flat(tree, "")), "path string, leaf string, subjects string")


_LEAF = "SELECT '{}' AS path, 'order:1#{}' AS leaf, coalesce((SELECT 'customer:' || CAST({} AS VARCHAR) FROM orders WHERE o_orderkey = 1 AND {}), '') AS subjects".format
_add(
    "expand_tree",
    _expand,
    " UNION ALL ".join([_LEAF("/exclusion0", "owner", "o_custkey", "true"), _LEAF("/exclusion1/union0", "watcher", "o_custkey", "o_orderstatus = 'F'"), _LEAF("/exclusion1/union1", "auditor", "o_custkey + 1", "o_orderstatus = 'O'")]),
)


# --- more set laws, arrows and expressions, on a schema of their own ---------------

MORE = """
use expiration

caveat limit(amount double, max double) { amount <= max }
caveat named(name string, start string) { name.startsWith(start) ? name.endsWith("5") : name.contains("77") }
caveat like(name string) { name.matches("^Clerk#0*[1-4][0-9]*$") || size(name) < 3 }
caveat priced(price double, bulk bool) { (bulk ? price / 2.0 : price + 1000.0) >= 100000.0 }
caveat one_of(status string, allowed list<string>) { status in allowed }
caveat sums(sizes list<int>) { sizes.exists(i, i == 4) || sizes.filter(i, i > 1).size() >= 2 || sizes.exists_one(i, i % 2 == 0) && sizes.map(i, i * i)[0] > 3 }
caveat within(at timestamp, now timestamp, span duration) { now - at <= span || at.getFullYear() == 1995 }
caveat under(tags map<any>, most map<any>) { tags.isSubtreeOf(most) }

definition user {}
definition region {}
definition customer {}
definition nation {
  relation region: region
  permission region_of = region
}
definition supplier {
  relation home: nation
  permission based_in = home->region_of
}
definition part {
  relation supplier: supplier
  permission from_region = supplier->based_in
}
definition order {
  relation placed_by: customer | supplier
  relation owner: customer with named | customer with like | customer with priced | customer with one_of | customer with sums | customer with within | customer with under | customer with limit | customer
  permission origin = placed_by->based_in
}
definition crate {
  relation order: order with limit
  permission open = order->owner
}
definition page {
  relation viewer: user | user:*
  relation banned: user | user:*
  permission without = viewer - banned
  permission with = viewer & banned
  permission either = viewer + banned
}
"""

_PAGE = {
    "viewer": "SELECT 'page' rt, CAST(doc_id AS VARCHAR) rid, 'viewer' rel, 'user' st, CASE WHEN lang = 'en' THEN '*' ELSE CAST(doc_id % 50 AS VARCHAR) END sid, '...' sr FROM documents",
    "banned": "SELECT 'page' rt, CAST(doc_id AS VARCHAR) rid, 'banned' rel, 'user' st, CASE WHEN doc_id % 3 = 0 THEN '*' ELSE CAST(doc_id % 7 AS VARCHAR) END sid, '...' sr FROM documents",
}
EDGES.update({f"page_{k}": v for k, v in _PAGE.items()})


def _more(spark: SparkSession, d: str, *names: str) -> Engine:
    return Engine(load(MORE), spark_edges(spark, d, *names))


_PAGE_SQL = "WITH p AS (SELECT DISTINCT doc_id, lang, CAST(u AS VARCHAR) AS u FROM (SELECT doc_id, lang, unnest([doc_id % 7, doc_id % 50]) AS u FROM documents)), q AS (SELECT *, (lang = 'en' OR u = CAST(doc_id % 50 AS VARCHAR)) AS v, (doc_id % 3 = 0 OR u = CAST(doc_id % 7 AS VARCHAR)) AS b FROM p) SELECT CAST(doc_id AS VARCHAR) AS resource_id, u AS subject_id, " + _STATE_SQL + " FROM q"
for _name, _perm, _cond in (("public_minus_public", "without", "v AND NOT b"), ("public_and_public", "with", "v AND b"), ("public_or_public", "either", "v OR b")):
    _add(_name, lambda s, d, p=_perm: _more(s, d, "page_viewer", "page_banned").check(_doc_pairs(s, d), "page", p, "user").select("resource_id", "subject_id", "permissionship"), _PAGE_SQL.format(_cond))


def _looked_up(permission: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pages = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("resource_id"))
        out = _more(spark, d, "page_viewer", "page_banned").lookup_subjects(pages, "page", permission, "user")
        return out.select("resource_id", "subject_id", F.array_join(F.transform("excluded", lambda x: x["subject_id"]), ",").alias("excluded"))

    return run


_V, _B = "lang = 'en'", "doc_id % 3 = 0"
_ID, _ONE, _SEVEN = "CAST(doc_id AS VARCHAR) AS resource_id", "CAST(doc_id % 50 AS VARCHAR)", "CAST(doc_id % 7 AS VARCHAR)"
_add(
    "public_minus_public_subjects",
    _looked_up("without"),
    f"SELECT {_ID}, '*' AS subject_id, {_SEVEN} AS excluded FROM documents WHERE {_V} AND NOT {_B} "
    f"UNION ALL SELECT {_ID}, {_ONE}, '' FROM documents WHERE NOT {_V} AND NOT {_B} AND doc_id % 50 <> doc_id % 7",
)
_add(
    "public_and_public_subjects",
    _looked_up("with"),
    f"SELECT {_ID}, '*' AS subject_id, '' AS excluded FROM documents WHERE {_V} AND {_B} UNION ALL SELECT {_ID}, {_SEVEN}, '' FROM documents WHERE {_V} AND NOT {_B} "
    f"UNION ALL SELECT {_ID}, {_ONE}, '' FROM documents WHERE NOT {_V} AND ({_B} OR doc_id % 50 = doc_id % 7)",
)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("string").alias("subject_id"))


_ARROWS = ("part_supplier", "supplier_home", "nation_region")
_add("arrow_lookup_resources", lambda s, d: _more(s, d, *_ARROWS).lookup_resources(_regions(s, d), "part", "from_region", "region").select("resource_id", "subject_id"), _pairs(_HOP.format(EDGES["part_supplier"])))
_add(
    "arrow_lookup_subjects",
    lambda s, d: _more(s, d, *_ARROWS).lookup_subjects(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("resource_id")), "part", "from_region", "region").select("resource_id", "subject_id"),
    _pairs(_HOP.format(EDGES["part_supplier"])),
)
#: Customers have no ``based_in``: their edges lead nowhere.
_add(
    "arrow_missing_permission",
    lambda s, d: _more(s, d, "placed_customer", "placed_supplier", "supplier_home", "nation_region").members("order", "origin", "region").select(F.col("resource").alias("resource_id"), F.col("subject").alias("subject_id")),
    _pairs(_HOP.format(EDGES["placed_supplier"])),
)


def _expression(caveat: str, context, request: dict, holds: str) -> tuple:
    """One edge per order under a caveat; every order checked for its owner."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("resource_id"), F.col("o_custkey").cast("string").alias("subject_id"))
        return Engine(load(MORE), _caveated("owner", caveat, context)(spark, d), request).check(pairs, "order", "owner", "customer").select("resource_id", "subject_id", "permissionship")

    return run, "SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS subject_id, " + _STATE_SQL.format(holds) + " FROM orders"


def _json(**values):
    return lambda: F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in values.items())))


_add("caveat_strings", *_expression("named", _json(name="concat('Clerk#', o_custkey)"), {"start": "Clerk#1"}, "CASE WHEN CAST(o_custkey AS VARCHAR) LIKE '1%' THEN CAST(o_custkey AS VARCHAR) LIKE '%5' ELSE CAST(o_custkey AS VARCHAR) LIKE '%77%' END"))
_add("caveat_matches", *_expression("like", _json(name="concat('Clerk#00', o_custkey)"), {}, "regexp_full_match(CAST(o_custkey AS VARCHAR), '[1-4][0-9]*')"))
_add("caveat_ternary", *_expression("priced", _json(price="floor(o_totalprice)", bulk="o_orderkey % 2 = 0"), {}, "CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) / 2 ELSE floor(o_totalprice) + 1000 END >= 100000"))
_add("caveat_in_list", *_expression("one_of", _json(status="o_orderstatus"), {"allowed": ["F", "P"]}, "o_orderstatus IN ('F', 'P')"))
_A, _C, _E = "o_orderkey % 5", "o_orderkey % 3", "o_custkey % 4"
_add(
    "caveat_macros",
    *_expression("sums", _json(sizes=f"array({_A}, {_C}, {_E})"), {}, f"{_A} = 4 OR (CASE WHEN {_A} > 1 THEN 1 ELSE 0 END + CASE WHEN {_C} > 1 THEN 1 ELSE 0 END + CASE WHEN {_E} > 1 THEN 1 ELSE 0 END) >= 2 OR ((CASE WHEN {_A} % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN {_C} % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN {_E} % 2 = 0 THEN 1 ELSE 0 END) = 1 AND {_A} * ({_A}) > 3)"),
)
_add(
    "caveat_durations",
    *_expression("within", lambda: F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))), {"now": "1998-01-01T00:00:00Z", "span": "8760h"}, "CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1997-01-01 00:00:00' OR year(o_orderdate) = 1995"),
)
_add("caveat_subtree", *_expression("under", _json(tags="map(o_orderstatus, o_orderkey % 2)"), {"most": {"F": 1, "O": 0, "X": 1}}, "(o_orderstatus = 'F' AND o_orderkey % 2 = 1) OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)"))


def _crates(spark: SparkSession, d: str) -> DataFrame:
    """The parent's caveat and the edge's own must both hold."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    up = complete(o.select(F.lit("crate").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("order").alias("relation"), F.lit("order").alias("subject_type"), F.col("o_orderkey").cast("string").alias("subject_id"), F.lit("limit").alias("caveat_name"), F.when(F.col("o_orderkey") % 4 > 0, F.to_json(F.struct((F.col("o_orderkey") % 4).alias("max")))).alias("caveat_context")))
    own = _caveated("owner", "one_of", _json(status="o_orderstatus"))(spark, d)
    pairs = o.select(F.col("o_orderkey").cast("string").alias("resource_id"), F.col("o_custkey").cast("string").alias("subject_id"))
    out = Engine(load(MORE), up.unionByName(own), {"amount": 2, "allowed": ["F", "P"]}).check(pairs, "crate", "open", "customer")
    return out.select("resource_id", "subject_id", "permissionship", F.array_join("missing", ",").alias("missing"))


_add(
    "arrow_parent_caveat",
    _crates,
    "SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CAST(o_custkey AS VARCHAR) AS subject_id, p AS permissionship, CASE WHEN p = 'CONDITIONAL' THEN 'max' ELSE '' END AS missing "
    "FROM (SELECT *, CASE WHEN o_orderstatus NOT IN ('F', 'P') OR o_orderkey % 4 = 1 THEN 'NO' WHEN o_orderkey % 4 = 0 THEN 'CONDITIONAL' ELSE 'HAS' END AS p FROM orders)",
)
_add("expiration_filter", lambda s, d: read(_temp(s, d).unionByName(spark_edges(s, d, "owner", "watcher")), Filter(type="order", expires=True)).select(*KEY), "SELECT 'order' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id, 'temp_viewer' AS relation, 'customer' AS subject_type, CAST(o_custkey AS VARCHAR) AS subject_id, '...' AS subject_relation FROM orders")
_add(
    "caveat_name_filter",
    lambda s, d: read(_caveated("owner", "limit", lambda: F.lit("{}"))(s, d).unionByName(_caveated("owner", "like", lambda: F.lit("{}"))(s, d).where("resource_id LIKE '%7'")), Filter(type="order", caveat="like")).select(*KEY, "caveat_name"),
    "SELECT 'order' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id, 'owner' AS relation, 'customer' AS subject_type, CAST(o_custkey AS VARCHAR) AS subject_id, '...' AS subject_relation, 'like' AS caveat_name FROM orders WHERE o_orderkey % 10 = 7",
)


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """Of edges signed under two keys: those changed since, and those whose key is unknown."""
    number = F.col("resource_id").cast("long")
    edges = spark_edges(spark, d, "owner")
    signed = sign(edges.where(number % 2 == 0), "k1", b"one").unionByName(sign(edges.where(number % 2 == 1), "k2", b"two"))
    changed = signed.withColumn("subject_id", F.when(number % 10 == 3, F.lit("forged")).otherwise(F.col("subject_id"))).withColumn("integrity_key_id", F.when(number % 10 == 4, F.lit("k9")).otherwise(F.col("integrity_key_id")))
    return verify(changed, {"k1": b"one", "k2": b"two"}).select("resource_id", "subject_id", "integrity_key_id")


_add("integrity_verify", _tampered, "SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CASE WHEN o_orderkey % 10 = 3 THEN 'forged' ELSE CAST(o_custkey AS VARCHAR) END AS subject_id, CASE WHEN o_orderkey % 10 = 3 THEN 'k2' ELSE 'k9' END AS integrity_key_id FROM orders WHERE o_orderkey % 10 IN (3, 4)")


def _exported(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as partitioned text and read back."""
    path = f"{work_dir(spark)}/export-{uuid.uuid4().hex}"
    write_text(spark_edges(spark, d, "owner", "watcher", "group_tree"), path)
    return read_text(spark, path).select(*KEY)


_add("export_partitioned", _exported, f"SELECT {_KEYS_SQL} FROM ({_sql('owner', 'watcher', 'group_tree')})")
