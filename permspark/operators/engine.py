"""Checks, lookups and expansion over a schema and edges, many at a time."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.functions.caveats import ERROR, with_state
from permspark.operators.reads import CursorError, after, complete, live
from permspark.plans.compiler import STAR, Compiler
from permspark.plans.dsl import Arrow, Nil, Op, Ref, Schema, Self
from permspark.plans.schema import load

STATES = {0: "NO", 1: "CONDITIONAL", 2: "HAS"}


def _name(state, missing=None):
    """The answer's name; ERROR where a condition rests on a caveat that couldn't be evaluated."""
    some = F.when(state == 1, "CONDITIONAL")
    if missing is not None:
        some = F.when((state == 1) & F.exists(missing, lambda m: m.startswith(ERROR)), "ERROR").when(state == 1, "CONDITIONAL")
    return some.when(state == 2, "HAS").otherwise("NO")


def _cursor(request: list, key: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([_hash(request), *key]).encode()).decode()


def _hash(request: list) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Engine:
    """One schema, one snapshot of edges, one request context, one time.

    Caveats are evaluated once per edge when edges are scanned. ``as_of`` fixes the time for
    expirations; without it edges don't expire.
    """

    def __init__(self, schema: Schema | str, edges: DataFrame, context: dict | None = None, as_of: datetime | str | None = None, max_depth: int = 50) -> None:
        self.schema = load(schema) if isinstance(schema, str) else schema
        rows = complete(edges)
        rows = live(rows, as_of) if as_of is not None else rows
        self.edges = self._with_false(rows, context)
        free = rows.where("caveat_name IS NULL") if self.schema.caveats else rows
        self.plain = free.withColumns({"state": F.lit(2), "missing": F.array().cast("array<string>")})
        self.spark: SparkSession = edges.sparkSession
        self.context, self.max_depth = context, max_depth

    def _with_false(self, rows: DataFrame, context: dict | None) -> DataFrame:
        every = any(isinstance(e, Arrow) and e.every for d in self.schema.definitions.values() for p in d.permissions.values() for e in _leaves(p.expr))
        return with_state(rows, self.schema, context, keep_false=every)

    def compiler(self, subject: tuple[str, str], subjects: DataFrame | None = None) -> Compiler:
        if subject[0] not in self.schema.definitions:
            raise ValueError(f"no type {subject[0]!r}")
        if subject[1] != "..." and not self.schema.definitions[subject[0]].has(subject[1]):
            raise ValueError(f"no relation {subject[0]}#{subject[1]}")
        return Compiler(self.schema, self.edges, subject, subjects, self.max_depth, self.plain)

    def members(self, type_: str, permission: str, subject_type: str, subject_relation: str = "...") -> DataFrame:
        """The whole member table."""
        return self.compiler((subject_type, subject_relation)).members((type_, permission))

    def check(self, pairs: DataFrame, type_: str, permission: str, subject_type: str, subject_relation: str = "...") -> DataFrame:
        """pairs (resource_id, subject_id, any others) with permissionship and missing.

        Rows keep their number and other columns. Only the pairs' subjects are sought, and
        only from the pairs' objects; wildcards are looked up per object, not expanded.
        """
        subjects = pairs.select(F.col("subject_id").alias("id")).distinct()
        objects = pairs.select(F.col("resource_id").alias("id")).distinct()
        m = self.compiler((subject_type, subject_relation), subjects).members((type_, permission), objects)
        one = m.where(F.col("subject") != STAR).select(F.col("resource").alias("_r"), F.col("subject").alias("_s"), F.col("state").alias("_st"), F.col("missing").alias("_m"))
        star = m.where(F.col("subject") == STAR).select(F.col("resource").alias("_wr"), F.col("state").alias("_w"), F.col("missing").alias("_wm"))
        out = pairs.join(one, (F.col("resource_id") == F.col("_r")) & (F.col("subject_id") == F.col("_s")), "left").join(star, F.col("resource_id") == F.col("_wr"), "left")
        state = F.coalesce("_st", "_w", F.lit(0))
        missing = F.when(state == 1, F.coalesce("_m", "_wm")).otherwise(F.array().cast("array<string>"))
        out = out.withColumns({"permissionship": _name(state, missing), "missing": missing}).drop("_r", "_s", "_st", "_m", "_wr", "_w", "_wm")
        bad = F.when(F.col("subject_id") == STAR, F.raise_error(F.lit("a wildcard can't be checked"))).otherwise(F.col("permissionship"))
        return out.withColumn("permissionship", bad)

    def check_one(self, resource: str, permission: str, subject: str) -> str:
        """``type:id``, permission, ``type:id[#relation]`` to HAS, CONDITIONAL or NO."""
        (rt, rid), (st, sid) = resource.split(":", 1), subject.split(":", 1)
        sid, _, sr = sid.partition("#")
        pairs = self.spark.createDataFrame([(rid, sid)], "resource_id string, subject_id string")
        return self.check(pairs, rt, permission, st, sr or "...").first().permissionship

    def check_bulk(self, items: Iterable[tuple[str, str, str]]) -> list[str]:
        """Answers in the order of (resource, permission, subject) items; an unknown name is that item's error.

        Items that share types and permission are one job. A caveat that can't be evaluated is the
        error of the items whose answer rests on it.
        """
        groups: dict = {}
        for i, (resource, permission, subject) in enumerate(items):
            (rt, rid), (st, sid) = resource.split(":", 1), subject.split(":", 1)
            sid, _, sr = sid.partition("#")
            groups.setdefault((rt, permission, st, sr or "..."), []).append((i, rid, sid))
        out: dict[int, str] = {}
        for (rt, permission, st, sr), rows in groups.items():
            out |= {i: "ERROR: a wildcard can't be checked" for i, _, s in rows if s == STAR}
            rows = [r for r in rows if r[2] != STAR]
            if not rows:
                continue
            try:
                df = self.spark.createDataFrame(rows, "ordinal int, resource_id string, subject_id string")
                found = self.check(df, rt, permission, st, sr).select("ordinal", "permissionship", "missing").collect()
                out |= {r.ordinal: "ERROR: " + "; ".join(m.removeprefix(ERROR) for m in r.missing if m.startswith(ERROR)) if r.permissionship == "ERROR" else r.permissionship for r in found}
            except ValueError as e:
                out |= {i: f"ERROR: {e}" for i, _, _ in rows}
        return [out[i] for i in sorted(out)]

    def lookup_resources(self, subjects: DataFrame, type_: str, permission: str, subject_type: str, subject_relation: str = "...", public: str = "each") -> DataFrame:
        """(subject_id, resource_id, permissionship, missing) for each subject of ``subjects`` (subject_id).

        An object open to everybody is a result for each subject that it doesn't exclude; that is as many rows as
        there are. With public="star" it is one row of the subject ``*`` instead, and the subjects whose
        answer differs have rows of their own, also those with NO.
        """
        if public not in ("each", "star"):
            raise ValueError("public is each or star")
        wanted = subjects.select(F.col("subject_id").alias("id")).distinct()
        m = self.compiler((subject_type, subject_relation), wanted).members((type_, permission))
        if public == "star":
            own = m.where((F.col("subject") == STAR) | (F.col("state") != F.col("w")))
            return own.select(F.col("subject").alias("subject_id"), F.col("resource").alias("resource_id"), _name(F.col("state"), F.col("missing")).alias("permissionship"), "missing")
        listed = m.where((F.col("subject") != STAR) & (F.col("state") > 0)).select("subject", "resource", "state", "missing")
        if Compiler(self.schema, self.edges, (subject_type, subject_relation)).wild([(type_, permission)]):
            # a public object is a result for each subject asked for, but those it excludes
            stars = m.where(F.col("subject") == STAR).select("resource", "state", "missing")
            pairs = stars.join(wanted.select(F.col("id").alias("subject")))
            pairs = pairs.join(m.where(F.col("subject") != STAR).select("resource", "subject"), ["resource", "subject"], "left_anti")
            listed = listed.unionByName(pairs.select("subject", "resource", "state", "missing"))
        return listed.select(F.col("subject").alias("subject_id"), F.col("resource").alias("resource_id"), _name(F.col("state"), F.col("missing")).alias("permissionship"), "missing")

    def lookup_resources_page(self, subjects: DataFrame, type_: str, permission: str, subject_type: str, subject_relation: str = "...", limit: int = 1000, cursor: str | None = None) -> tuple[list, str | None]:
        """Rows of lookup_resources() by (resource_id, subject_id) behind a cursor, and the next cursor; None at the end.

        The cursor holds the last row and a hash of the request: types, permission, context and the page's subjects' plan
        are the caller's to keep, another type, permission or context raises. A page is a filtered top-k.
        """
        if limit < 1:
            raise ValueError("a page has one row at least")
        request, order = [type_, permission, subject_type, subject_relation, self.context], ["resource_id", "subject_id"]
        found = self.lookup_resources(subjects, type_, permission, subject_type, subject_relation)
        if cursor is not None:
            try:
                told, *key = json.loads(base64.urlsafe_b64decode(cursor))
            except ValueError as e:
                raise CursorError("not a cursor") from e
            if told != _hash(request) or len(key) != 2:
                raise CursorError("the cursor is of another request")
            found = found.where((F.col("resource_id") >= key[0]) & after(order, key))  # the first part reaches the scan
        rows = found.orderBy(*order).limit(limit).collect()
        return rows, None if len(rows) < limit else _cursor(request, [rows[-1].resource_id, rows[-1].subject_id])

    def lookup_subjects(self, objects: DataFrame, type_: str, permission: str, subject_type: str, subject_relation: str = "...") -> DataFrame:
        """(resource_id, subject_id, permissionship, missing, excluded) for each object of ``objects`` (resource_id).

        The wildcard is the subject ``*``; excluded then lists who is taken out of it, with
        NO or CONDITIONAL.
        """
        seed = objects.select(F.col("resource_id").alias("id")).distinct()
        m = self.compiler((subject_type, subject_relation)).members((type_, permission), seed)
        none = F.array().cast("array<struct<subject_id:string,permissionship:string>>")
        out = (F.col("subject") != STAR) & ((F.col("state") == 0) | ((F.col("state") == 1) & (F.col("w") == 2)))
        excluded = m.where(out).groupBy(F.col("resource").alias("_r")).agg(F.array_sort(F.collect_list(F.struct(F.col("subject").alias("subject_id"), _name(F.col("state"), F.col("missing")).alias("permissionship")))).alias("_x"))
        rows = m.where(~out).join(excluded, (F.col("resource") == F.col("_r")) & (F.col("subject") == STAR), "left")
        return rows.select(F.col("resource").alias("resource_id"), F.col("subject").alias("subject_id"), _name(F.col("state"), F.col("missing")).alias("permissionship"), "missing", F.coalesce("_x", none).alias("excluded"))

    def expand(self, resource: str, permission: str, deep: bool = False) -> dict:
        """The tree of set operations over one object, with its stored subjects at the leaves.

        ``conditions`` name what subjects lack that have a caveat without an answer. With ``deep`` the usersets
        among a leaf's subjects are expanded in its ``children``, too; one that is met again on its own
        path is left as it is.
        """
        if not self.schema.definitions[resource.split(":", 1)[0]].has(permission):
            raise ValueError(f"no relation or permission {resource.split(':', 1)[0]}#{permission}")
        return self._expand(resource, permission, deep, frozenset())

    def _expand(self, resource: str, permission: str, deep: bool, path: frozenset) -> dict:
        type_, id_ = resource.split(":", 1)
        d, path = self.schema.definitions[type_], path | {f"{resource}#{permission}"}

        def leaf(name: str) -> dict:
            rows = self.edges.where((F.col("resource_type") == type_) & (F.col("resource_id") == id_) & (F.col("relation") == name) & (F.col("state") > 0)).collect()
            label = lambda r: f"{r.subject_type}:{r.subject_id}" + ("" if r.subject_relation == "..." else f"#{r.subject_relation}")
            out = {"leaf": f"{type_}:{id_}#{name}", "subjects": sorted(map(label, rows))}
            if lacking := {label(r): list(r.missing) for r in rows if r.state == 1}:
                out["conditions"] = lacking
            if deep and (sets := sorted(label(r) for r in rows if r.subject_relation != "..." and label(r) not in path)):
                out["children"] = [self._expand(*s.split("#"), deep, path) for s in sets]
            return out

        def walk(e) -> dict:
            match e:
                case Nil():
                    return {"leaf": "nil", "subjects": []}
                case Self():
                    return {"leaf": "self", "subjects": [resource]}
                case Ref(name):
                    return leaf(name) if name in d.relations else {"expanded": f"{resource}#{name}"} | walk(d.permissions[name].expr)
                case Op(op, parts):
                    return {"operation": {"+": "union", "&": "intersection", "-": "exclusion"}[op], "children": [walk(p) for p in parts]}
                case Arrow(relation, target, every):
                    found, kids = leaf(relation), []
                    for s in found["subjects"]:
                        obj = s.split("#")[0]
                        if self.schema.definitions[obj.split(":")[0]].has(target) and f"{obj}#{target}" not in path:
                            kid = {"leaf": f"{obj}#{target}", "subjects": self._expand(obj, target, deep, path)}
                            if s in found.get("conditions", ()):
                                kid["conditions"] = {s: found["conditions"][s]}
                            kids.append(kid)
                    return {"operation": "intersection" if every else "union", "children": kids}
            raise TypeError(e)

        return walk(Ref(permission))

    def permissions(self, resource_type: str, permission: str, subject_type: str, resource_id: str | None = None, subject_id: str | None = None, subject_relation: str = "...") -> DataFrame:
        """What is bound decides: both ids check, a subject looks up objects, an object subjects."""
        one = lambda name, v: self.spark.createDataFrame([(v,)], f"{name} string")
        if resource_id is not None and subject_id is not None:
            pairs = self.spark.createDataFrame([(resource_id, subject_id)], "resource_id string, subject_id string")
            out = self.check(pairs, resource_type, permission, subject_type, subject_relation)
        elif subject_id is not None:
            out = self.lookup_resources(one("subject_id", subject_id), resource_type, permission, subject_type, subject_relation)
        elif resource_id is not None:
            out = self.lookup_subjects(one("resource_id", resource_id), resource_type, permission, subject_type, subject_relation)
        else:
            raise ValueError("bind resource_id, subject_id or both")
        return out.select("resource_id", "subject_id", "permissionship", "missing")

    def register_views(self, prefix: str = "") -> None:
        """Temporary views ``relationships`` and ``schema``, for SQL."""
        from permspark.plans.schema import reflect

        self.edges.drop("state", "missing").createOrReplaceTempView(f"{prefix}relationships")
        self.spark.createDataFrame(reflect(self.schema), "kind string, definition string, name string, detail string").createOrReplaceTempView(f"{prefix}schema")


def _leaves(e):
    if isinstance(e, Op):
        for p in e.parts:
            yield from _leaves(p)
    else:
        yield e
