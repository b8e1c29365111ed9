"""Edges in tables: Parquet laid out by type and relation, JSON, CSV, JDBC; validation files."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.operators.reads import KEY, complete
from permspark.plans.schema import subject_types as reachable_subjects


def write_edges(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by (resource_type, relation), which nearly every scan fixes; rows sorted by object."""
    df.repartition("resource_type", "relation", F.pmod(F.xxhash64("resource_id"), F.lit(64))).sortWithinPartitions("resource_type", "relation", "resource_id").write.mode(mode).partitionBy("resource_type", "relation").parquet(path)


def read_edges(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    return complete(spark.read.format(form).options(**options).load(path))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple | None = None, n: int = 16, **options) -> DataFrame:
    """A relational store's edge table, read in parallel ranges of a numeric column."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", n)
    return complete(r.load())


@dataclass
class ValidationFile:
    """A schema, edges, and what should hold of them."""

    schema: str
    relationships: list[str]
    true: list[tuple[str, dict]] = field(default_factory=list)
    caveated: list[tuple[str, dict]] = field(default_factory=list)
    false: list[tuple[str, dict]] = field(default_factory=list)
    #: By object and permission the subjects expected: (subject, conditional, what a wildcard excludes)
    expected: dict[str, list[tuple[str, bool, tuple[str, ...]]]] = field(default_factory=dict)


_SUBJECT = re.compile(r"^\[([^\[\] ]+)(\[\.\.\.\])?(?: - \{([^}]*)\})?\](?: is .*)?$")


def _expected(line: str) -> tuple[str, bool, tuple[str, ...]]:
    """From ``[user:a] is <doc:x#viewer>``, ``[user:a[...]]`` or ``[user:* - {user:b, user:c}]``; the way there is ignored."""
    m = _SUBJECT.match(line.strip())
    if not m:
        raise ValueError(f"not an expected subject: {line!r}")
    return m[1], bool(m[2]), tuple(sorted(x.strip() for x in (m[3] or "").split(",") if x.strip()))


def validation_file(text: str, read: Callable[[str], str] | None = None) -> ValidationFile:
    """From YAML with schema (or schemaFile, given to ``read``), relationships, assertions and validation."""
    import yaml

    y = yaml.safe_load(text)
    if "schema" not in y and read is None:
        raise ValueError("the file has no schema, and nothing to read schemaFile with")
    lines = [x.strip() for x in (y.get("relationships") or "").splitlines()]

    def assertions(key: str) -> list[tuple[str, dict]]:
        out = []
        for a in (y.get("assertions") or {}).get(key) or []:
            edge, _, context = a.partition(" with ")
            out.append((edge.strip(), json.loads(context) if context else {}))
        return out

    expected = {k: [_expected(x) for x in v or []] for k, v in (y.get("validation") or {}).items()}
    schema = y["schema"] if "schema" in y else read(y["schemaFile"])
    return ValidationFile(schema, [x for x in lines if x and not x.startswith("//")], assertions("assertTrue"), assertions("assertCaveated"), assertions("assertFalse"), expected)


def failures(spark: SparkSession, v: ValidationFile) -> list[str]:
    """What a validation file asks for that doesn't hold: assertions, then expected subjects."""
    from permspark.operators.engine import Engine
    from permspark.sources.text import from_texts

    edges, out = from_texts(spark, v.relationships).cache(), []
    asked: dict[str, list[tuple[str, str]]] = {}
    for want, items in (("HAS", v.true), ("CONDITIONAL", v.caveated), ("NO", v.false)):
        for edge, context in items:
            asked.setdefault(json.dumps(context, sort_keys=True), []).append((edge, want))
    for context, items in asked.items():  # those of one context are one bulk check
        parts = [re.fullmatch(r"([^#]+)#([^@]+)@(.+)", edge) for edge, _ in items]
        answers = Engine(v.schema, edges, json.loads(context)).check_bulk([p.groups() for p in parts])
        out += [f"{edge} with {context}: {got}, not {want}" for (edge, want), got in zip(items, answers, strict=True) if got != want]
    engine = Engine(v.schema, edges)
    for node, subjects in v.expected.items():
        obj, permission = node.split("#")
        type_, id_ = obj.split(":", 1)
        objects, found = spark.createDataFrame([(id_,)], "resource_id string"), set()
        for st, sr in sorted({(s.split(":")[0], (s.split("#") + ["..."])[1]) for s, _, _ in subjects} | reachable_subjects(engine.schema, (type_, permission))):
            if sr != "..." and not any(s.split(":")[0] == st and s.endswith(f"#{sr}") for s, _, _ in subjects):
                continue  # usersets are only looked for where some are expected
            tail = "" if sr == "..." else f"#{sr}"
            for r in engine.lookup_subjects(objects, type_, permission, st, sr).collect():
                found.add((f"{st}:{r.subject_id}{tail}", r.permissionship == "CONDITIONAL", tuple(sorted(f"{st}:{x.subject_id}" for x in r.excluded))))
        out += [f"{node}: {x} expected" for x in sorted(set(subjects) - found)] + [f"{node}: {x} not expected" for x in sorted(found - set(subjects))]
    return out


# --- integrity ---------------------------------------------------------------------


def canonical() -> Column:
    """The text that is signed."""
    return F.concat_ws("\x1f", *KEY, F.coalesce("caveat_name", F.lit("")), F.coalesce("caveat_context", F.lit("")), F.coalesce(F.col("expiration").cast("string"), F.lit("")))


def _hmac(keys: dict[str, bytes]):
    """The HMAC of a text under the key of an id; null where the id is unknown."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(keys[i], t.encode(), hashlib.sha256).digest() if i in keys else None for i, t in zip(ids, texts, strict=True)], dtype=object)

    return run


def sign(df: DataFrame, key_id: str, key: bytes) -> DataFrame:
    """df with integrity_key_id and integrity_hash (HMAC-SHA256; Spark has no such function)."""
    return df.withColumn("integrity_key_id", F.lit(key_id)).withColumn("integrity_hash", _hmac({key_id: key})(F.lit(key_id), canonical()))


def verify(df: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Edges whose hash does not fit or whose key is unknown; one scan for all keys."""
    return df.where(~_hmac(dict(keys))(F.col("integrity_key_id"), canonical()).eqNullSafe(F.col("integrity_hash")) | F.col("integrity_key_id").isNull() | ~F.col("integrity_key_id").isin(*keys))
