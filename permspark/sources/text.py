"""Edges as text: ``type:id#relation@type:id[#relation][caveat:{json}][expiration:RFC3339]``."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permspark.operators.reads import EDGE, KEY

#: Fixed values (the forms of names and ids); one expression for Python and for Java.
_TYPE = r"(?:[a-z][a-z0-9_]{1,61}[a-z0-9]/)*[a-z][a-z0-9_]{1,62}[a-z0-9]"
_REL = r"[a-z][a-z0-9_]{1,62}[a-z0-9]"
_ID = r"[a-zA-Z0-9/_|\-=+]+"
PATTERN = (
    rf"^\s*({_TYPE}):({_ID})#({_REL})@({_TYPE}):({_ID}|\*)(?:#({_REL}|\.\.\.))?"
    rf"(?:\[((?:{_TYPE}))(?::(\{{.*\}}))?\])?(?:\[expiration:([\d\-T:.]+Z?)\])?\s*$"
)


class TextError(ValueError):
    """Text that is not an edge."""


def parse_column(line: Column) -> Column:
    """struct of EDGE columns, null where the line is not an edge; stays in the JVM."""
    g = lambda i: F.regexp_extract(line, PATTERN, i)
    or_null = lambda c: F.when(c != "", c)
    s = F.struct(
        g(1).alias("resource_type"), g(2).alias("resource_id"), g(3).alias("relation"), g(4).alias("subject_type"), g(5).alias("subject_id"),
        F.coalesce(or_null(g(6)), F.lit("...")).alias("subject_relation"), or_null(g(7)).alias("caveat_name"), or_null(g(8)).alias("caveat_context"),
        F.try_to_timestamp(or_null(g(9))).alias("expiration"),
    )
    return F.when(line.rlike(PATTERN), s)


def format_column() -> Column:
    """The text of an edge."""
    caveat = F.when(F.col("caveat_name").isNotNull(), F.concat(F.lit("["), "caveat_name", F.coalesce(F.concat(F.lit(":"), "caveat_context"), F.lit("")), F.lit("]"))).otherwise("")
    when = F.when(F.col("expiration").isNotNull(), F.concat(F.lit("[expiration:"), F.date_format("expiration", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("]"))).otherwise("")
    rel = F.when(F.col("subject_relation") != "...", F.concat(F.lit("#"), "subject_relation")).otherwise("")
    return F.concat("resource_type", F.lit(":"), "resource_id", F.lit("#"), "relation", F.lit("@"), "subject_type", F.lit(":"), "subject_id", rel, caveat, when)


def parse_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Edges of a column of lines; blank lines and // comments are skipped, others raise or are dropped."""
    df = lines.where(~F.col(column).rlike(r"^\s*(//.*)?$")).withColumn("_e", parse_column(F.col(column)))
    if strict:
        df = df.withColumn("_e", F.when(F.col("_e").isNull(), F.raise_error(F.concat(F.lit("not an edge: "), column))).otherwise(F.col("_e")))
    return df.where("_e IS NOT NULL").select("_e.*")


def read_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_lines(spark.read.text(path), strict=strict)


def write_text(df: DataFrame, path: str, n: int | None = None) -> None:
    """A full export in key order: disjoint ranges, one file each."""
    out = df.repartitionByRange(n, *KEY) if n else df.repartitionByRange(*KEY)
    out.sortWithinPartitions(*KEY).select(format_column().alias("value")).write.text(path)


def parse_edge(text: str) -> tuple:
    """One edge on the driver, as a tuple of EDGE values; the expiration stays text."""
    m = re.match(PATTERN, text)
    if not m:
        raise TextError(f"not an edge: {text!r}")
    g = list(m.groups())
    g[5] = g[5] or "..."
    if g[7]:
        json.loads(g[7])
    return tuple(g)


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return parse_lines(spark.createDataFrame([(t,) for t in texts], "value string")) if texts else spark.createDataFrame([], EDGE)
