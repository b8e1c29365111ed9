"""Writing edges: validation, CREATE / TOUCH / DELETE, preconditions, bulk loads, counters.

An MVCC table has edges with created_rev and deleted_rev. apply_updates() and delete_matching() give the
table of a new revision, as a plan; a Store keeps events in a folder, appending those of each write.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permspark.functions import cel
from permspark.operators.reads import EDGE, KEY, Filter, SubjectSelector, collect_garbage, complete, fold, read
from permspark.plans.dsl import Schema, generate
from permspark.plans.materialize import work_dir
from permspark.plans.schema import load

HISTORY = EDGE + ", created_rev long, deleted_rev long"
EVENTS = EDGE + ", operation string, revision long"
EDGE_COLUMNS = [x.split()[0] for x in EDGE.split(", ")]
#: The forms of names and ids, and the longest id.
TYPE = r"^([a-z][a-z0-9_]{1,61}[a-z0-9]/)*[a-z][a-z0-9_]{1,62}[a-z0-9]$"
RELATION = r"^(\.\.\.|[a-z][a-z0-9_]{1,62}[a-z0-9])$"
ID = r"^(([a-zA-Z0-9/_|\-=+]{1,})|\*)$"
MAX_ID = 1024


class WriteError(ValueError):
    """A write breaks a rule; nothing was written."""


def allowed_types(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [
        (d.name, r.name, a.type, "*" if a.wildcard else a.relation, a.caveat or "", a.expiration)
        for d in schema.definitions.values()
        for r in d.relations.values()
        for a in r.allowed
    ]
    return spark.createDataFrame(rows, "t string, r string, st string, sr string, c string, x boolean")


def violations(schema: Schema, df: DataFrame) -> DataFrame:
    """Edges that the schema does not allow, with the reason. The schema's rows are few and are broadcast."""
    allowed = F.broadcast(allowed_types(df.sparkSession, schema))
    kind = F.when(F.col("subject_id") == "*", "*").otherwise(F.col("subject_relation"))
    ok = (
        (F.col("resource_type") == F.col("t")) & (F.col("relation") == F.col("r")) & (F.col("subject_type") == F.col("st")) & (kind == F.col("sr"))
        & (F.coalesce("caveat_name", F.lit("")) == F.col("c")) & (F.col("expiration").isNotNull() == F.col("x"))
    )
    permissions = [f"{d.name}#{p}" for d in schema.definitions.values() for p in d.permissions]
    reason = (
        F.when(~F.col("resource_type").rlike(TYPE) | ~F.col("subject_type").rlike(TYPE), "type")
        .when(~F.col("relation").rlike(RELATION) | ~F.col("subject_relation").rlike(RELATION), "relation")
        .when(~F.col("resource_id").rlike(ID) | (F.col("resource_id") == "*") | ~F.col("subject_id").rlike(ID), "id")
        .when((F.length("resource_id") > MAX_ID) | (F.length("subject_id") > MAX_ID), "id")
        .when((F.col("subject_id") == "*") & (F.col("subject_relation") != "..."), "wildcard")
        .when(F.concat_ws("#", "resource_type", "relation").isin(permissions or [""]), "permission")
    )
    broken = df.withColumn("reason", reason)
    named = broken.where("reason IS NOT NULL")
    rest = broken.where("reason IS NULL").drop("reason").join(allowed, ok, "left_anti").withColumn("reason", F.lit("not allowed"))
    return named.unionByName(rest)


def check_context(schema: Schema, df: DataFrame) -> None:
    """Stored contexts name parameters of their caveat, with values of its types. Distinct pairs only."""

    caveats = dict(schema.caveats)

    def reason(name: str, context: str) -> str | None:
        c = caveats.get(name)
        try:
            for k, v in json.loads(context).items():
                if c is None or k not in c.params:
                    raise cel.CelError(f"caveat {name} has no parameter {k}")
                cel.coerce(v, c.params[k])
        except (ValueError, AttributeError) as e:
            return str(e)
        return None

    def bad(batches):
        for b in batches:
            found = [reason(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in found if x is not None], pa.string())], names=["reason"])

    found = df.where("caveat_context IS NOT NULL").select("caveat_name", "caveat_context").distinct().mapInArrow(bad, "reason string").take(1)
    if found:
        raise WriteError(found[0][0])


def validate(schema: Schema, df: DataFrame) -> None:
    found = violations(schema, df).limit(3).collect()
    if found:
        raise WriteError("; ".join(f"{r.resource_type}:{r.resource_id}#{r.relation}@{r.subject_type}:{r.subject_id}: {r.reason}" for r in found))
    if schema.caveats:
        check_context(schema, df)


def check_preconditions(df: DataFrame, preconditions: list[tuple[str, Filter]]) -> None:
    """(must_match | must_not_match, filter); each looks for one row."""
    for kind, f in preconditions:
        if (not df.where(f.column()).isEmpty()) != (kind == "must_match"):
            raise WriteError(f"precondition {kind} fails: {f}")


def checked_updates(now: DataFrame, updates: DataFrame, schema: Schema | None, preconditions: list[tuple[str, Filter]]) -> DataFrame:
    """updates with all columns of EDGE; raises if they break a rule against the live edges."""
    updates = complete_updates(updates)
    twice = updates.groupBy(*KEY).count().where("count > 1").limit(1).collect()
    if twice:
        raise WriteError(f"an edge is updated twice: {twice[0]}")
    if schema is not None:
        validate(schema, updates.where("operation <> 'DELETE'").drop("operation"))
    check_preconditions(now, preconditions)
    clash = now.join(updates.where("operation = 'CREATE'").select(*KEY), KEY, "left_semi").limit(1).collect()
    if clash:
        raise WriteError(f"the edge exists: {clash[0]}")
    return updates


def update_events(now: DataFrame, updates: DataFrame, revision: int, schema: Schema | None = None, preconditions: list[tuple[str, Filter]] = ()) -> DataFrame:
    """The events of one revision that updates make on the live edges; the rules are those of apply_updates()."""
    updates = checked_updates(now, updates, schema, preconditions)
    rest = ["caveat_name", "caveat_context", "expiration"]
    old = now.select(*(F.col(k).alias(f"o_{k}") for k in KEY), *(F.col(c).alias(f"o_{c}") for c in rest))
    j = updates.join(old, [F.col(k) == F.col(f"o_{k}") for k in KEY], "left")
    there, same = F.col(f"o_{KEY[0]}").isNotNull(), F.lit(True)
    for c in rest:
        same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
    gone = F.col("operation") == "DELETE"
    j = j.where(F.when(gone, there).otherwise(~(there & same)))
    blank = [F.when(~gone, F.col(c)).alias(c) for c in rest]
    return j.select(*KEY, *blank, F.when(gone, "DELETE").otherwise("TOUCH").alias("operation"), F.lit(revision).cast("long").alias("revision")).select(*EDGE_COLUMNS, "operation", "revision")


def apply_updates(history: DataFrame, updates: DataFrame, revision: int, schema: Schema | None = None, preconditions: list[tuple[str, Filter]] = ()) -> DataFrame:
    """history after updates (EDGE columns and ``operation``: CREATE, TOUCH or DELETE).

    CREATE of a live edge raises; TOUCH replaces unless nothing differs; DELETE of nothing
    is nothing; an edge updated twice in one call raises.
    """
    now = history.where("deleted_rev IS NULL")
    updates = checked_updates(now, updates, schema, preconditions)
    u = updates.select(*(F.col(k).alias(f"u_{k}") for k in KEY), F.col("operation").alias("u_op"), *(F.col(c).alias(f"u_{c}") for c in ("caveat_name", "caveat_context", "expiration")))
    on = [F.col(k) == F.col(f"u_{k}") for k in KEY]
    same = F.col("caveat_name").eqNullSafe(F.col("u_caveat_name")) & F.col("caveat_context").eqNullSafe(F.col("u_caveat_context")) & F.col("expiration").eqNullSafe(F.col("u_expiration"))
    ends = F.col("u_op").isNotNull() & ~((F.col("u_op") == "TOUCH") & same)
    columns = [x.split()[0] for x in HISTORY.split(", ")]
    old = now.join(u, on, "left").withColumn("deleted_rev", F.when(ends, F.lit(revision)).cast("long")).select(*columns)
    kept = now.select(*KEY, "caveat_name", "caveat_context", "expiration").alias("n")
    writes = updates.where("operation <> 'DELETE'").alias("w")
    new = writes.join(kept, [F.col(f"w.{k}") == F.col(f"n.{k}") for k in KEY] + [F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("caveat_name", "caveat_context", "expiration")], "left_anti")
    new = new.select("w.*").drop("operation").withColumn("created_rev", F.lit(revision).cast("long")).withColumn("deleted_rev", F.lit(None).cast("long"))
    return history.where("deleted_rev IS NOT NULL").select(*columns).unionByName(old).unionByName(new.select(*columns))


def complete_updates(updates: DataFrame) -> DataFrame:
    return complete(updates.drop("operation")) if "operation" not in updates.columns else updates.select("operation", *[c for c in updates.columns if c != "operation"]).transform(lambda d: complete_with(d))


def complete_with(d: DataFrame) -> DataFrame:
    have = set(d.columns)
    kinds = dict(x.rsplit(" ", 1) for x in EDGE.split(", "))
    return d.select(*((F.col(c) if c in have else F.lit("..." if c == "subject_relation" else None)).cast(k).alias(c) for c, k in kinds.items()), "operation")


def matching(now: DataFrame, f: Filter, limit: int | None = None, allow_partial: bool = False) -> tuple[DataFrame, str]:
    """The live edges that a deletion takes, and COMPLETE or PARTIAL."""
    hits = now.where(f.column())
    if limit is None or hits.limit(limit + 1).count() <= limit:
        return hits, "COMPLETE"
    if not allow_partial:
        raise WriteError(f"more than {limit} edges match")
    return hits.orderBy(*KEY).limit(limit), "PARTIAL"


def delete_matching(history: DataFrame, f: Filter, revision: int, limit: int | None = None, allow_partial: bool = False) -> tuple[DataFrame, str]:
    """history without the live edges that match, and COMPLETE or PARTIAL.

    With a limit, more matches raise unless partial deletion is allowed; then the first
    ``limit`` by key go.
    """
    live_rows = history.where("deleted_rev IS NULL")
    hits, progress = matching(live_rows, f, limit, allow_partial)
    gone = hits.select(*(F.col(k).alias(f"g_{k}") for k in KEY)).withColumn("gone", F.lit(True))
    on = [F.col(k) == F.col(f"g_{k}") for k in KEY]
    columns = [x.split()[0] for x in HISTORY.split(", ")]
    out = live_rows.join(gone, on, "left").withColumn("deleted_rev", F.when(F.col("gone"), F.lit(revision)).cast("long")).select(*columns)
    return history.where("deleted_rev IS NOT NULL").select(*columns).unionByName(out), progress


def schema_change_violations(old: Schema, new: Schema, df: DataFrame) -> list[str]:
    """What a schema change would take away although edges still use it."""
    out = []
    for d in old.definitions.values():
        n = new.definitions.get(d.name)
        if n is None:
            if not df.where((F.col("resource_type") == d.name) | (F.col("subject_type") == d.name)).isEmpty():
                out.append(f"type {d.name} has edges")
            continue
        for r in d.relations.values():
            rows = df.where((F.col("resource_type") == d.name) & (F.col("relation") == r.name))
            if r.name not in n.relations:
                if not rows.isEmpty():
                    out.append(f"relation {d.name}#{r.name} has edges")
            elif set(r.allowed) - set(n.relations[r.name].allowed) and not violations(new, rows).isEmpty():
                out.append(f"allowed types of {d.name}#{r.name} are in use")
    return out


class ConflictError(WriteError):
    """Another writer has committed the revision meanwhile; nothing was written."""


class Store:
    """Edges on disk with revisions, in a folder of its own; opened again, it goes on where it was.

    Each write appends a folder of events (TOUCH and DELETE of that revision), whatever the
    size of the rest, and commits it by creating one file that must not exist yet: of two
    writers of a revision one gets a ConflictError. The file lists the folders of the state, the
    schema and the counters. compact() merges the folders. Without ``path`` the store lives in the work
    folder, until it is cleared away.
    """

    def __init__(self, spark: SparkSession, schema: Schema | None = None, path: str | None = None, history: DataFrame | None = None) -> None:
        self.spark = spark
        self.path = (path or f"{work_dir(spark)}/store-{uuid.uuid4().hex}").rstrip("/")
        self.revision, self.oldest, self.folders, self.counters, self.schema = 0, 0, [], {}, schema
        self.refresh()
        if self.revision == 0 and schema is None:
            raise WriteError(f"no store at {self.path}")
        if history is not None and self.revision == 0:
            top = history.agg(F.max(F.greatest("created_rev", "deleted_rev"))).first()[0]
            self.revision = max(0, (top or 1) - 1)  # the first commit is of the history's last revision
            self._commit(self._as_events(history))

    # --- files ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def refresh(self) -> int:
        """Takes over what other writers have committed; the head revision."""
        fs, folder = self._fs(f"{self.path}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.isdecimal()]
        if names and int(names[-1]) > self.revision:
            fs, file = self._fs(f"{self.path}/commits/{names[-1]}")
            stream = fs.open(file)
            try:
                state = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
            self.revision, self.oldest, self.folders = int(names[-1]), state["oldest"], state["folders"]
            self.schema = load(state["schema"])
            self.counters = {k: _filter(v) for k, v in state["counters"].items()}
        return self.revision

    def _commit(self, events: DataFrame | None, folders: list[str] | None = None, oldest: int | None = None) -> int:
        """Writes events as a new folder, then the commit file of the next revision."""
        folders = list(self.folders if folders is None else folders)
        revision = self.revision + 1
        if events is not None:
            folders.append(f"events-{revision:012d}-{uuid.uuid4().hex}")
            events.write.parquet(f"{self.path}/{folders[-1]}")
        oldest = self.oldest if oldest is None else oldest
        state = {"folders": folders, "oldest": oldest, "schema": generate(self.schema), "counters": {k: asdict(v) for k, v in self.counters.items()}}
        fs, file = self._fs(f"{self.path}/commits/{revision:012d}")
        try:
            out = fs.create(file, False)
        except Py4JJavaError as e:
            raise ConflictError(f"revision {revision} was committed by another writer") from e
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        self.revision, self.folders, self.oldest = revision, folders, oldest
        return revision

    def _as_events(self, history: DataFrame) -> DataFrame:
        """TOUCH at each created_rev, DELETE at each deleted_rev that no TOUCH follows at once."""
        rest = ["caveat_name", "caveat_context", "expiration"]
        touched = history.select(*EDGE_COLUMNS, F.lit("TOUCH").alias("operation"), F.col("created_rev").alias("revision"))
        gone = history.where("deleted_rev IS NOT NULL").select(*KEY, *(F.lit(None).cast(k).alias(c) for c, k in zip(rest, ("string", "string", "timestamp"), strict=True)), F.lit("DELETE").alias("operation"), F.col("deleted_rev").alias("revision"))
        both = touched.select(*KEY, *rest, "operation", "revision").unionByName(gone)
        return fold(both).select(*EDGE_COLUMNS, "operation", "revision")

    def events(self) -> DataFrame:
        """All events that are kept: EDGE columns, operation, revision."""
        if not self.folders:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(*(f"{self.path}/{f}" for f in self.folders))

    # --- reading ---

    @property
    def history(self) -> DataFrame:
        """The MVCC table: each event lasts until the edge's next one."""
        order = Window.partitionBy(*KEY).orderBy("revision")
        out = self.events().withColumn("deleted_rev", F.lead("revision").over(order)).where("operation = 'TOUCH'")
        return out.select(*EDGE_COLUMNS, F.col("revision").alias("created_rev"), "deleted_rev")

    def at(self, revision: int | None = None) -> DataFrame:
        """Edges that live at a revision (None: the head): the last event of each up to it. No window, minima map-side."""
        if revision is not None and not self.oldest <= revision <= self.revision:
            raise WriteError(f"revision {revision} is not available ({self.oldest} to {self.revision} are)")
        rest = ["caveat_name", "caveat_context", "expiration"]
        e = self.events() if revision is None else self.events().where(F.col("revision") <= revision)
        last = e.groupBy(*KEY).agg(F.max_by(F.struct("operation", *rest), "revision").alias("x")).where("x.operation = 'TOUCH'")
        return last.select(*KEY, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*EDGE_COLUMNS)

    def changes(self, after: int = 0) -> DataFrame:
        if after < self.oldest:
            raise WriteError(f"changes after {after} are gone; the oldest revision is {self.oldest}")
        return self.events().where(F.col("revision") > after).select("revision", "operation", *EDGE_COLUMNS)

    # --- writing ---

    def write(self, updates: DataFrame, preconditions=()) -> int:
        """Applies updates (EDGE columns and ``operation``) as apply_updates() does, as one revision."""
        return self._commit(update_events(self.at(), updates, self.revision + 1, self.schema, list(preconditions)))

    def delete(self, f: Filter, limit: int | None = None, allow_partial: bool = False, preconditions=()) -> str:
        now = self.at()
        check_preconditions(now, list(preconditions))
        hits, progress = matching(now, f, limit, allow_partial)
        rest = [F.lit(None).cast(k).alias(c) for c, k in (("caveat_name", "string"), ("caveat_context", "string"), ("expiration", "timestamp"))]
        self._commit(hits.select(*KEY, *rest, F.lit("DELETE").alias("operation"), F.lit(self.revision + 1).cast("long").alias("revision")).select(*EDGE_COLUMNS, "operation", "revision"))
        return progress

    def bulk_load(self, df: DataFrame, checked: bool = True) -> int:
        """Appends new edges; checked: they must be allowed. Existing edges raise, and edges that come twice."""
        df = complete(df)
        if checked:
            validate(self.schema, df)
        if not df.join(self.at().select(*KEY), KEY, "left_semi").isEmpty():
            raise WriteError("some edges exist")
        if not df.groupBy(*KEY).count().where("count > 1").isEmpty():
            raise WriteError("an edge comes twice")
        return self._commit(df.select(*EDGE_COLUMNS, F.lit("TOUCH").alias("operation"), F.lit(self.revision + 1).cast("long").alias("revision")))

    def compact(self, horizon: int | None = None, as_of=None) -> int:
        """Merges the folders into one, as a new revision; with a horizon without what no snapshot from it on can see."""
        history = self.history if horizon is None else collect_garbage(self.history, horizon, as_of)
        return self._commit(self._as_events(history), [], max(self.oldest, horizon or 0))

    def register_counter(self, name: str, f: Filter) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]{1,62}[a-z0-9]", name) or name in self.counters:
            raise WriteError(f"counter {name!r} exists or has no valid name")
        self.counters[name] = f
        self._commit(None)

    def unregister_counter(self, name: str) -> None:
        if name not in self.counters:
            raise WriteError(f"no counter {name!r}")
        del self.counters[name]
        self._commit(None)

    def count(self, name: str) -> int:
        if name not in self.counters:
            raise WriteError(f"no counter {name!r}")
        return read(self.at(), self.counters[name]).count()

    def replace_schema(self, new: Schema) -> None:
        bad = schema_change_violations(self.schema, new, self.at())
        if bad:
            raise WriteError("; ".join(bad))
        old, self.schema = self.schema, new
        try:
            self._commit(None)
        except ConflictError:
            self.schema = old
            raise


def _filter(d: dict) -> Filter:
    subjects = tuple(SubjectSelector(s["type"], tuple(s["ids"]), tuple(s["relations"])) for s in d["subjects"])
    return Filter(**(d | {"ids": tuple(d["ids"]), "subjects": subjects}))


def statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("resource_type", "relation").agg(F.count(F.lit(1)).alias("n_edges"))
