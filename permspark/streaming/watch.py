"""Watching changes: a stream of events, folded and ordered by revision, with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from permspark.operators.reads import EDGE, KEY, Filter, decode_token, fold

EVENT = "revision long, operation string, " + EDGE


def stream(spark: SparkSession, path: str, form: str = "parquet", after: int = 0, **options) -> DataFrame:
    """Events that arrive as files in a folder, strictly after a revision."""
    return spark.readStream.schema(EVENT).format(form).options(**options).load(path).where(F.col("revision") > after)


def only(events: DataFrame, types: list[str] | None = None, filters: list[Filter] | None = None) -> DataFrame:
    """Events of object types or of any filter; not both."""
    if types and filters:
        raise ValueError("object types and filters exclude each other")
    if types:
        return events.where(F.col("resource_type").isin(*types))
    if filters:
        some = F.lit(False)
        for f in filters:
            some |= f.column()
        return events.where(some)
    return events


class RevisionError(RuntimeError):
    """Events of a revision came after that revision was delivered as whole."""


def watch(events: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, schema: bool = False) -> StreamingQuery:
    """Runs emit(changes by revision, checkpoint) whenever revisions are whole.

    Structured Streaming gives no order across tasks and may cut a revision in two, so a revision is
    held back until an event of a later one has come, or a CHECKPOINT event (operation CHECKPOINT, its
    revision) says that it is whole. What is held is a table beside the stream's checkpoint, one for each batch. Whole
    revisions are folded (TOUCH beats DELETE) and sorted; the checkpoint is the largest of them, and
    no change up to it comes later: an event that does raises RevisionError. With ``schema`` SCHEMA events
    (a new schema was written at the revision) are passed on, else left out. Without changes only a new checkpoint is told.
    A batch that runs again after a failure has the same rows and the same checkpoint.
    """
    held = f"{checkpoint.rstrip('/')}/held"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        columns = [x.split()[0] for x in EVENT.split(", ")]
        rows, done = df.select(*columns), -1
        if number:
            before = spark.read.schema(EVENT).parquet(f"{held}/{number - 1}")
            done = before.where("operation = 'DELIVERED'").agg(F.max("revision")).first()[0]
            rows = rows.unionByName(before.where("operation <> 'DELIVERED'"))
        rows = rows.persist()
        try:
            mark = F.col("operation") == "CHECKPOINT"
            low, last, told = rows.agg(F.min(F.when(~mark, F.col("revision"))), F.max("revision"), F.max(F.when(mark, F.col("revision")))).first()
            if low is not None and low <= done:
                raise RevisionError(f"an event of revision {low} came after {done} was delivered")
            whole = max(done, -1 if last is None else last - 1, -1 if told is None else told)
            blank = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EVENT.split(", ")[2:]]
            end = spark.range(1).select(F.lit(whole).cast("long").alias("revision"), F.lit("DELIVERED").alias("operation"), *blank)
            rows.where((F.col("revision") > whole) & ~mark).unionByName(end).coalesce(1).write.mode("overwrite").parquet(f"{held}/{number}")
            if whole > done:
                now = rows.where((F.col("revision") <= whole) & ~mark)
                out = fold(now.where("operation <> 'SCHEMA'")).select(*columns)
                if schema:
                    out = out.unionByName(now.where("operation = 'SCHEMA'").select(*columns))
                emit(out.orderBy("revision", *KEY), whole)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def resume(token: str, datastore: str = "permspark", oldest: int = 0) -> int:
    """The revision that a token names, to watch from; raises if it is of another datastore or its changes are gone."""
    revision = decode_token(token, datastore)
    if revision < oldest:
        raise RevisionError(f"changes after revision {revision} are gone; the oldest is {oldest}")
    return revision


def tumbling_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by window and operation, with a watermark for late data."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "operation").agg(F.count(F.lit(1)).alias("n"))
