"""Caveats on edges: evaluated once per edge, at the scan, to a state.

State 2 is true, 1 unknown for want of context, 0 false. An edge whose caveat or context is not
valid is unknown, too; what it lacks then begins with ``ERROR``, so that one bad edge spoils
the answers that rest on it and no others. Context stored with an edge overrides the request's. Distinct (caveat, stored context) pairs of a batch are evaluated
once, in Arrow batches; edges without a caveat never leave the JVM.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permspark.functions import cel
from permspark.plans.dsl import Caveat, Schema

NO, MAYBE, YES = 0, 1, 2
RESULT = "state int, missing array<string>"
#: Begins what is missing where evaluation failed; no parameter's name holds a colon.
ERROR = "error: "


def evaluate(caveat: Caveat, stored: dict, request: dict) -> tuple[int, list[str]]:
    """State and the parameters that were missing; parameters the caveat doesn't have are skipped."""
    env = {k: cel.coerce(v, caveat.params[k]) for k, v in {**request, **stored}.items() if k in caveat.params}
    out = cel.evaluate(cel.parse(caveat.expr), env)
    if isinstance(out, cel.Unknown):
        return MAYBE, sorted(out.names)
    if not isinstance(out, bool):
        raise cel.CelError(f"caveat {caveat.name} gives {out!r}, not a bool")
    return (YES if out else NO), []


def state_of(schema: Schema, name: Column, stored: Column, request: dict | None = None) -> Column:
    """struct(state, missing) of an edge's caveat."""
    caveats, context = dict(schema.caveats), dict(request or {})

    @F.pandas_udf(RESULT)
    def run(names: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for n, c in zip(names, contexts, strict=True):
            if n is None:
                out.append((YES, []))
                continue
            if (n, c) not in known:
                try:
                    if n not in caveats:
                        raise cel.CelError(f"no caveat {n!r}")
                    known[n, c] = evaluate(caveats[n], json.loads(c) if c else {}, context)
                except (ValueError, AttributeError, RecursionError) as e:
                    known[n, c] = (MAYBE, [f"{ERROR}{n}: {e}"])
            out.append(known[n, c])
        return pd.DataFrame(out, columns=["state", "missing"])

    return run(name, stored)


def with_state(edges: DataFrame, schema: Schema, request: dict | None = None, keep_false: bool = False) -> DataFrame:
    """edges with state and missing; those that are false only if wanted. Without caveats in the schema: literals."""
    plain = edges.where("caveat_name IS NULL") if schema.caveats else edges
    plain = plain.withColumn("state", F.lit(YES)).withColumn("missing", F.array().cast("array<string>"))
    if not schema.caveats:
        return plain
    some = edges.where("caveat_name IS NOT NULL").withColumn("_s", state_of(schema, F.col("caveat_name"), F.col("caveat_context"), request))
    some = some.withColumn("state", F.col("_s.state")).withColumn("missing", F.col("_s.missing")).drop("_s")
    return plain.unionByName(some if keep_false else some.where(F.col("state") > NO))
