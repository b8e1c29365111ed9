"""Edges: their schema, filters, sorting, paging, snapshots."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.plans.dsl import Schema

KEY = ["resource_type", "resource_id", "relation", "subject_type", "subject_id", "subject_relation"]
EDGE = (
    "resource_type string, resource_id string, relation string, subject_type string, subject_id string, "
    "subject_relation string, caveat_name string, caveat_context string, expiration timestamp"
)
BY_SUBJECT = ["subject_type", "subject_id", "subject_relation", "resource_type", "resource_id", "relation"]
ELLIPSIS = "..."


def edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edges from tuples of six to nine values."""
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], EDGE)


def complete(df: DataFrame) -> DataFrame:
    """df with the columns of EDGE; absent ones are null, an absent subject relation is '...'."""
    kinds = dict(x.rsplit(" ", 1) for x in EDGE.split(", "))
    have = set(df.columns)
    fill = {"subject_relation": F.lit(ELLIPSIS)}
    return df.select(*((F.col(c) if c in have else fill.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()))


@dataclass(frozen=True)
class SubjectSelector:
    type: str | None = None
    ids: tuple[str, ...] = ()
    #: Any of "...", a relation's name, or "non-ellipsis" for all but "..."
    relations: tuple[str, ...] = ()

    def column(self) -> Column:
        out = F.lit(True)
        if self.type:
            out &= F.col("subject_type") == self.type
        if self.ids:
            out &= F.col("subject_id").isin(*self.ids)
        if self.relations:
            named = [r for r in self.relations if r != "non-ellipsis"]
            ok = F.col("subject_relation").isin(*named) if named else F.lit(False)
            if "non-ellipsis" in self.relations:
                ok |= F.col("subject_relation") != ELLIPSIS
            out &= ok
        return out


@dataclass(frozen=True)
class Filter:
    """Which edges; at least one field. Ids and a prefix exclude each other."""

    type: str | None = None
    ids: tuple[str, ...] = ()
    prefix: str | None = None
    relation: str | None = None
    subjects: tuple[SubjectSelector, ...] = field(default=())
    #: A caveat's name, "none" for edges without, None for any
    caveat: str | None = None
    #: True: with expiration, False: without, None: any
    expires: bool | None = None

    def __post_init__(self) -> None:
        if self.ids and self.prefix:
            raise ValueError("ids and prefix exclude each other")
        if not (self.type or self.ids or self.prefix or self.relation or self.subjects or self.caveat) and self.expires is None:
            raise ValueError("a filter needs a field")

    def column(self) -> Column:
        """A conjunction that reaches the scan as pushed filters."""
        out = F.lit(True)
        if self.type:
            out &= F.col("resource_type") == self.type
        if self.ids:
            out &= F.col("resource_id").isin(*self.ids)
        if self.prefix:
            out &= F.col("resource_id").startswith(self.prefix)
        if self.relation:
            out &= F.col("relation") == self.relation
        if self.subjects:
            some = F.lit(False)
            for s in self.subjects:
                some |= s.column()
            out &= some
        if self.caveat:
            out &= F.col("caveat_name").isNull() if self.caveat == "none" else F.col("caveat_name") == self.caveat
        if self.expires is not None:
            out &= F.col("expiration").isNotNull() if self.expires else F.col("expiration").isNull()
        return out


def check_filter(schema: Schema, f: Filter) -> None:
    """Raises if a filter names what the schema doesn't have, or asks for edges that it can't have."""
    definitions = schema.definitions.values()
    if f.type and f.type not in schema.definitions:
        raise ValueError(f"no type {f.type!r}")
    relations = [(d, r) for d in definitions if f.type in (None, d.name) for r in d.relations.values() if f.relation in (None, r.name)]
    if f.relation and not relations:
        raise ValueError(f"no relation {f.relation!r}" + (f" in {f.type}" if f.type else ""))
    if f.caveat and f.caveat != "none" and f.caveat not in schema.caveats:
        raise ValueError(f"no caveat {f.caveat!r}")
    allowed = [a for _, r in relations for a in r.allowed]
    for s in f.subjects:
        if s.type and s.type not in schema.definitions:
            raise ValueError(f"no type {s.type!r}")
        named = {x for x in s.relations if x not in (ELLIPSIS, "non-ellipsis")}
        if s.type and any(not schema.definitions[s.type].has(x) for x in named):
            raise ValueError(f"no relation {sorted(named)} in {s.type}")
        fits = [a for a in allowed if s.type in (None, a.type) and (not s.relations or a.relation in s.relations or ("non-ellipsis" in s.relations and a.relation != ELLIPSIS))]
        if s.ids and set(s.ids) == {"*"}:
            fits = [a for a in fits if a.wildcard]
        if not fits:
            raise ValueError(f"no edge can have a subject like {s}")
    if f.caveat and f.caveat != "none" and not any(a.caveat == f.caveat for a in allowed):
        raise ValueError(f"no such edge can have the caveat {f.caveat!r}")


def live(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Edges that have not expired at as_of."""
    return df.where(F.col("expiration").isNull() | (F.col("expiration") > F.lit(as_of).cast("timestamp")))


def read(df: DataFrame, f: Filter | None = None, as_of: datetime | str | None = None) -> DataFrame:
    out = df if f is None else df.where(f.column())
    return out if as_of is None else live(out, as_of)


class CursorError(ValueError):
    """The cursor is of another request."""


def _request(f: Filter | None, order: list[str]) -> str:
    return hashlib.sha256(json.dumps([asdict(f) if f else None, order], sort_keys=True).encode()).hexdigest()[:16]


def page(df: DataFrame, f: Filter | None = None, limit: int = 1000, cursor: str | None = None, by_subject: bool = False, as_of=None) -> tuple[list, str | None]:
    """Rows in order after a cursor, and the next cursor; None at the end.

    The cursor holds the last key, so a page costs a filtered top-k, whatever came before.
    """
    order = BY_SUBJECT if by_subject else KEY
    out = read(df, f, as_of)
    if cursor:
        c = json.loads(base64.urlsafe_b64decode(cursor))
        if c["request"] != _request(f, order):
            raise CursorError("the cursor is of another request")
        out = out.where(after(order, c["key"]))
    rows = out.orderBy(*order).limit(limit).collect()
    if len(rows) < limit:
        return rows, None
    token = {"request": _request(f, order), "key": [rows[-1][c] for c in order]}
    return rows, base64.urlsafe_b64encode(json.dumps(token).encode()).decode()


def after(order: list[str], key: list[str]) -> Column:
    """Rows behind a key in an order, as a comparison of structs."""
    return F.struct(*order) > F.struct(*(F.lit(v).alias(c) for c, v in zip(order, key, strict=True)))


# --- snapshots -------------------------------------------------------------------


def snapshot(history: DataFrame, revision: int | None = None) -> DataFrame:
    """Edges of an MVCC table (created_rev, deleted_rev) that live at a revision; None: the head."""
    if revision is None:
        return history.where("deleted_rev IS NULL").drop("created_rev", "deleted_rev")
    rev = F.lit(revision)
    return history.where((F.col("created_rev") <= rev) & (F.col("deleted_rev").isNull() | (F.col("deleted_rev") > rev))).drop("created_rev", "deleted_rev")


def changes(history: DataFrame, after_revision: int, until: int | None = None) -> DataFrame:
    """TOUCH and DELETE events by revision; in one revision a TOUCH beats a DELETE of the same edge."""
    touched = history.select(F.col("created_rev").alias("revision"), F.lit("TOUCH").alias("operation"), *KEY, "caveat_name", "caveat_context", "expiration")
    gone = history.where("deleted_rev IS NOT NULL").select(F.col("deleted_rev").alias("revision"), F.lit("DELETE").alias("operation"), *KEY, *(F.lit(None).cast(t).alias(c) for c, t in (("caveat_name", "string"), ("caveat_context", "string"), ("expiration", "timestamp"))))
    return fold(touched.unionByName(gone).where((F.col("revision") > after_revision) & (F.lit(True) if until is None else F.col("revision") <= until)))


def fold(events: DataFrame) -> DataFrame:
    """One event for each edge and revision; TOUCH wins. The maximum of a struct: no window, no sort."""
    rest = ["caveat_name", "caveat_context", "expiration"]
    x = F.max(F.struct((F.col("operation") == "TOUCH").alias("t"), *rest)).alias("x")
    out = events.groupBy("revision", *KEY).agg(x)
    return out.select("revision", F.when(F.col("x.t"), "TOUCH").otherwise("DELETE").alias("operation"), *KEY, *(F.col(f"x.{c}").alias(c) for c in rest))


def collect_garbage(history: DataFrame, horizon: int, as_of=None) -> DataFrame:
    """history without what no snapshot at or after horizon can see; with as_of, without expired edges."""
    out = history.where(F.col("deleted_rev").isNull() | (F.col("deleted_rev") > horizon))
    return out if as_of is None else live(out, as_of)


def encode_token(revision: int, datastore: str = "permspark") -> str:
    return base64.urlsafe_b64encode(json.dumps({"datastore": datastore, "revision": revision}).encode()).decode()


def decode_token(token: str, datastore: str = "permspark") -> int:
    t = json.loads(base64.urlsafe_b64decode(token))
    if t["datastore"] != datastore:
        raise ValueError("the token is of another datastore")
    return t["revision"]


def pick_revision(head: int, consistency: str = "minimize_latency", quantum: int = 1, oldest: int = 0) -> int:
    """``minimize_latency`` (head rounded down to a quantum), ``fully_consistent``, ``>=token`` or ``@token``."""
    if consistency == "fully_consistent":
        return head
    quick = max(oldest, head // quantum * quantum)
    if consistency == "minimize_latency":
        return quick
    want = decode_token(consistency.removeprefix(">=").removeprefix("@"))
    if want > head or want < oldest:
        raise ValueError(f"revision {want} is not available")
    return max(want, quick) if consistency.startswith(">=") else want
