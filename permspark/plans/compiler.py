"""Permissions compiled to DataFrames: who is a member of what, for many objects at once.

A member table has rows (resource, subject, state, missing, w) for one kind of subject
(type and relation). State is 2 for members, 1 where context is missing (then
``missing`` names it), 0 only to take a subject out of a wildcard. A wildcard is the row
with subject ``*``; ``w`` repeats its state on all rows of its resource, so what a
subject that isn't listed has is known without expanding anything. Set operators then
are three-valued logic on states, subject by subject, plus once for ``*``.

Objects that can't reach a wildcard skip all of that: union is a group-by with a maximum,
intersection an inner join, exclusion a left join. Recursion is a fixpoint over a
strongly connected component of the schema, semi-naive where every step is a union;
each ply is written to the shared folder. Data may be cyclic; a component that has not
settled after ``max_depth`` plies raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permspark.plans.dsl import Arrow, Nil, Op, Ref, Schema, Self, show
from permspark.plans.materialize import cut
from permspark.plans.schema import Node, component, parts_of, reaches, simplify, wildcard_in

STAR = "*"
MEMBERS = "resource string, subject string, state int, missing array<string>, w int"


class DepthError(RuntimeError):
    """Recursion went deeper than max_depth."""


def union_missing(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def _gather(state: str, missing: str) -> Column:
    """The distinct missing names of rows in state 1."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col(state) == 1, F.col(missing))))))


def merge(df: DataFrame, wild: bool) -> DataFrame:
    """Union of sets: each input row's w is that of the set it came from."""
    if not wild:
        out = df.groupBy("resource", "subject").agg(F.max("state").alias("state"), _gather("state", "missing").alias("missing"))
        return _tidy(out.withColumn("w", F.lit(0)))
    df = cut(df)  # read twice below; nested, that would double the work at each level
    listed = df.where(F.col("subject") != STAR).groupBy("resource", "subject").agg(
        F.max("state").alias("s"), F.count(F.when(F.col("w") == 2, 1)).alias("k2"), F.count(F.when(F.col("w") == 1, 1)).alias("k1"), _gather("state", "missing").alias("m")
    )
    stars = df.where(F.col("subject") == STAR).groupBy(F.col("resource").alias("r")).agg(
        F.max("state").alias("w"), F.count(F.when(F.col("state") == 2, 1)).alias("n2"), F.count(F.when(F.col("state") == 1, 1)).alias("n1"), _gather("state", "missing").alias("wm")
    )
    j = listed.join(stars, F.col("resource") == F.col("r"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = F.greatest(F.col("s"), F.when(zero(F.col("n2")) > F.col("k2"), 2).when(zero(F.col("n1")) > F.col("k1"), 1).otherwise(0))
    rows = j.select("resource", "subject", state.alias("state"), union_missing(F.col("m"), F.coalesce("wm", F.array().cast("array<string>"))).alias("missing"), zero(F.col("w")).alias("w"))
    rows = rows.where("state > 0 OR w > 0")
    return _tidy(rows.unionByName(stars.select(F.col("r").alias("resource"), F.lit(STAR).alias("subject"), F.col("w").alias("state"), F.col("wm").alias("missing"), "w")))


def _tidy(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("resource", "subject", F.col("state").cast("int").alias("state"), F.when(F.col("state") == 1, F.col("missing")).otherwise(none).alias("missing"), F.col("w").cast("int").alias("w"))


def combine(a: DataFrame, b: DataFrame, op: str, wild: bool) -> DataFrame:
    """``&`` or ``-`` of two sets."""
    value = F.least if op == "&" else lambda x, y: F.least(x, 2 - y)
    if wild:  # each side is read twice below
        a, b = cut(a), cut(b)
    b = b.select(F.col("resource").alias("r2"), F.col("subject").alias("s2"), F.col("state").alias("st2"), F.col("missing").alias("m2"), F.col("w").alias("w2"))
    same = (F.col("resource") == F.col("r2")) & (F.col("subject") == F.col("s2"))
    if not wild:
        j = a.join(b, same, "inner" if op == "&" else "left")
        st2, m2 = (F.coalesce("st2", F.lit(0)), F.coalesce("m2", F.array().cast("array<string>")))
        out = j.select("resource", "subject", value(F.col("state"), st2).alias("state"), union_missing(F.col("missing"), m2).alias("missing"), F.lit(0).alias("w"))
        return _tidy(out.where("state > 0"))
    wa = a.where(F.col("subject") == STAR).select(F.col("resource").alias("ra"), F.col("state").alias("sa"), F.col("missing").alias("ma"))
    wb = b.where(F.col("s2") == STAR).select(F.col("r2").alias("rb"), F.col("st2").alias("sb"), F.col("m2").alias("mb"))
    j = a.join(b, same, "full").select(F.coalesce("resource", "r2").alias("resource"), F.coalesce("subject", "s2").alias("subject"), "state", "missing", "st2", "m2")
    j = j.join(wa, F.col("resource") == F.col("ra"), "left").join(wb, F.col("resource") == F.col("rb"), "left")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    x, y = F.coalesce("state", "sa", zero), F.coalesce("st2", "sb", zero)
    w = value(F.coalesce("sa", zero), F.coalesce("sb", zero))
    missing = union_missing(F.coalesce("missing", "ma", none), F.coalesce("m2", "mb", none))
    out = j.select("resource", "subject", value(x, y).alias("state"), missing.alias("missing"), w.alias("w"))
    return _tidy(out.where(F.when(F.col("subject") == STAR, F.col("state") > 0).otherwise((F.col("state") > 0) | (F.col("w") > 0))))


class Compiler:
    """Member tables of one kind of subject, over edges that have state and missing.

    ``subjects`` (a column id) keeps only those among the concrete subjects; without it
    all are found. Wildcards are never expanded to it. ``plain`` are the edges without a caveat:
    relations that the schema allows no caveat on read these alone.
    """

    def __init__(self, schema: Schema, edges: DataFrame, subject: tuple[str, str], subjects: DataFrame | None = None, max_depth: int = 50, plain: DataFrame | None = None) -> None:
        self.schema, self.edges, self.subject, self.subjects, self.max_depth = schema, edges, subject, subjects, max_depth
        self.plain, self.narrow = plain, False
        self.done: dict = {}
        self.seeded: dict = {}
        self.kept: dict = {}

    # --- pieces ---

    def empty(self) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([], MEMBERS)

    def wild(self, nodes) -> bool:
        return self.subject[1] == "..." and any(wildcard_in(self.schema, n, subject_type=self.subject[0]) for n in nodes)

    def scan(self, type_: str, relation: str, seed: DataFrame | None) -> DataFrame:
        e = self.kept.get((type_, relation))
        if e is None:
            e = self.edges if self.plain is None or any(a.caveat for a in self.schema.definitions[type_].relations[relation].allowed) else self.plain
            e = e.where((F.col("resource_type") == type_) & (F.col("relation") == relation))
        return e if seed is None else e.join(seed.select(F.col("id").alias("resource_id")), "resource_id", "left_semi")

    def direct(self, e: DataFrame) -> DataFrame:
        e = e.where((F.col("subject_type") == self.subject[0]) & (F.col("subject_relation") == self.subject[1]) & (F.col("state") > 0))
        rows = e.select(F.col("resource_id").alias("resource"), F.col("subject_id").alias("subject"), "state", "missing")
        if self.subjects is not None:
            wanted = rows.join(self.subjects.select(F.col("id").alias("subject")), "subject", "left_semi")
            rows = wanted.unionByName(rows.where(F.col("subject") == STAR)) if self.subject[1] == "..." else wanted
        return rows.withColumn("w", F.when(F.col("subject") == STAR, F.col("state")).otherwise(0))

    def identity(self, type_: str, seed: DataFrame | None) -> DataFrame:
        """Each object as its own subject."""
        if self.subjects is not None:
            ids = self.subjects.select("id")
        elif seed is not None:
            ids = seed.select("id")
        else:
            ids = self.edges.where(F.col("resource_type") == type_).select(F.col("resource_id").alias("id"))
        ids = ids.distinct()
        return ids.select(F.col("id").alias("resource"), F.col("id").alias("subject"), F.lit(2).alias("state"), F.array().cast("array<string>").alias("missing"), F.lit(0).alias("w"))

    def through(self, e: DataFrame, target: Node, env: dict, linear: frozenset) -> DataFrame:
        """Members of target, reached by edges to its objects, one row for each edge."""
        e = e.where((F.col("subject_type") == target[0]) & (F.col("state") > 0) & (F.col("subject_id") != STAR))
        seed = None if target in env else e.select(F.col("subject_id").alias("id")).distinct()
        m = self.node(target, env, linear, seed).select(F.col("resource").alias("mid"), "subject", F.col("state").alias("ms"), F.col("missing").alias("mm"), F.col("w").alias("mw"))
        j = e.select("resource_id", "subject_id", "state", "missing").join(m, F.col("subject_id") == F.col("mid"))
        return j.select(F.col("resource_id").alias("resource"), "subject", F.least("state", "ms").alias("state"), union_missing(F.col("missing"), F.col("mm")).alias("missing"), F.least("state", "mw").alias("w"))

    # --- nodes and expressions ---

    def node(self, node: Node, env: dict, linear: frozenset, seed: DataFrame | None) -> DataFrame:
        if node in env:
            return env[node]
        if not reaches(self.schema, node, self.subject):
            return self.empty()
        key = (node, id(seed))
        if not linear and not env and key in self.seeded:
            return self.seeded[key][0]
        if inside := component(self.schema, node):
            if self.narrow and seed is not None:
                found = self.fixpoint(inside, (node[0], seed))
                for n in found:
                    if not linear and not env and n[0] == node[0]:
                        self.seeded[n, id(seed)] = (found[n], seed)
                return found[node]
            if node not in self.done:
                self.done |= self.fixpoint(inside)
            return self.done[node]
        out = self.body(node, env, linear, seed)
        if not linear and not env:
            self.seeded[key] = (out, seed)  # the seed is kept, so that its id stays its own
        return out

    def body(self, node: Node, env: dict, linear: frozenset, seed: DataFrame | None) -> DataFrame:
        """Members of a node; with linear, only by way of those nodes."""
        type_, name = node
        d = self.schema.definitions[type_]
        if name in d.permissions:
            out = self.expr(type_, simplify(self.schema, type_, d.permissions[name].expr, self.subject), env, linear, seed)
            if self.subject == node and not linear:
                out = merge(out.unionByName(self.identity(type_, seed)), self.wild([node]))
            return out
        e = self.scan(type_, name, seed)
        parts = [] if linear else [self.direct(e)]
        for t, r in sorted({(a.type, a.relation) for a in d.relations[name].allowed if a.relation != "..."}):
            if linear and (t, r) not in linear:
                continue
            if reaches(self.schema, (t, r), self.subject):
                parts.append(self.through(e.where(F.col("subject_relation") == r), (t, r), env, linear))
        if self.subject == node and not linear:
            parts.append(self.identity(type_, seed))
        return merge(_all(parts), self.wild([node])) if parts else self.empty()

    def expr(self, type_: str, e, env: dict, linear: frozenset, seed: DataFrame | None) -> DataFrame:
        match e:
            case Nil():
                return self.empty()
            case Self():
                return self.identity(type_, seed) if self.subject == (type_, "...") else self.empty()
            case Ref(name):
                return self.node((type_, name), env, linear, seed)
            case Arrow(relation, target, every):
                nodes = [(t, target) for t in sorted({a.type for a in self.schema.definitions[type_].relations[relation].allowed}) if self.schema.definitions[t].has(target)]
                scan = self.scan(type_, relation, seed)
                if every:
                    return self.every(scan, nodes, env)
                parts = [self.through(scan, n, env, linear) for n in nodes if (not linear or n in linear) and reaches(self.schema, n, self.subject)]
                return merge(_all(parts), self.wild(nodes)) if parts else self.empty()
            case Op(op, parts):
                nodes = list(self.nodes_of(type_, e))
                if op == "+":
                    if linear:
                        parts = [p for p in parts if set(self.nodes_of(type_, p)) & linear]
                    found = [self.expr(type_, p, env, linear, seed) for p in parts]
                    return merge(_all(found), self.wild(nodes)) if found else self.empty()
                out = self.expr(type_, parts[0], env, frozenset(), seed)
                for p in parts[1:]:
                    out = combine(out, self.expr(type_, p, env, frozenset(), seed), op, self.wild(nodes))
                return out
        raise TypeError(show(e))

    def nodes_of(self, type_: str, e):
        """Nodes that an expression names."""
        for leaf in parts_of(e):
            match leaf:
                case Ref(name):
                    yield (type_, name)
                case Arrow(relation, target, _):
                    for a in self.schema.definitions[type_].relations[relation].allowed:
                        if self.schema.definitions[a.type].has(target):
                            yield (a.type, target)

    def every(self, e: DataFrame, nodes: list[Node], env: dict) -> DataFrame:
        """``.all``: members of the target of every object that edges lead to; without edges nobody.

        Relational division: per resource, the objects are counted, and per subject those
        that have it. An edge whose caveat is false, or to a type without the target, fails all.
        """
        e = e.groupBy("resource_id", "subject_type", "subject_id").agg(F.min("state").alias("state"), _gather("state", "missing").alias("missing"))
        total = e.groupBy(F.col("resource_id").alias("tr")).agg(F.count(F.lit(1)).alias("n"))
        parts = [self.through(e, n, env, frozenset()).withColumn("mid_type", F.lit(n[0])) for n in nodes if reaches(self.schema, n, self.subject)]
        if not parts:
            return self.empty()
        rows = _all(parts)
        g = rows.groupBy("resource", "subject").agg(
            F.min("state").alias("s"), F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("w") == 2, 1)).alias("k2"), F.count(F.when(F.col("w") == 1, 1)).alias("k1"), _gather("state", "missing").alias("missing")
        )
        g = g.join(total, F.col("resource") == F.col("tr"))
        if not self.wild(nodes):
            return _tidy(g.where("k = n AND s > 0").select("resource", "subject", F.col("s").alias("state"), "missing", F.lit(0).alias("w")))
        stars = rows.where(F.col("subject") == STAR).groupBy(F.col("resource").alias("sr")).agg(
            F.count(F.lit(1)).alias("ns"), F.count(F.when(F.col("state") == 2, 1)).alias("n2"), F.count(F.when(F.col("state") == 1, 1)).alias("n1"), F.min("state").alias("ws"), _gather("state", "missing").alias("wm")
        )
        j = g.join(stars, F.col("resource") == F.col("sr"), "left").na.fill(0, ["ns", "n2", "n1", "ws"])
        w = F.when(F.col("ns") == F.col("n"), F.col("ws")).otherwise(0)
        # objects that don't list the subject give it what their wildcard has
        rest, ones = F.col("n") - F.col("k"), F.col("n1") - F.col("k1")
        stars_left = (F.col("n2") - F.col("k2")) + ones
        state = F.when(F.col("subject") == STAR, w).otherwise(F.when(stars_left < rest, 0).when(ones > 0, F.least("s", F.lit(1))).otherwise(F.col("s")))
        out = j.select("resource", "subject", state.alias("state"), union_missing(F.col("missing"), F.coalesce("wm", F.array().cast("array<string>"))).alias("missing"), w.alias("w"))
        return _tidy(out.where(F.when(F.col("subject") == STAR, F.col("state") > 0).otherwise((F.col("state") > 0) | (F.col("w") > 0))))

    # --- recursion ---

    def _union_only(self, inside: set[Node]) -> bool:
        def ok(type_: str, e) -> bool:
            if isinstance(e, Op) and e.op != "+":
                return not set(self.nodes_of(type_, e)) & inside
            if isinstance(e, Op):
                return all(ok(type_, p) for p in e.parts)
            return not (isinstance(e, Arrow) and e.every and set(self.nodes_of(type_, e)) & inside)

        return all(ok(t, self.schema.definitions[t].permissions[n].expr) for t, n in inside if n in self.schema.definitions[t].permissions)

    def _stratified(self, inside: set[Node]) -> None:
        def look(type_: str, e) -> None:
            if isinstance(e, Op):
                if e.op == "-" and set(self.nodes_of(type_, e.parts[1])) & inside:
                    raise ValueError(f"{show(e)} subtracts what it rests on")
                for p in e.parts:
                    look(type_, p)

        for t, n in inside:
            if n in self.schema.definitions[t].permissions:
                look(t, self.schema.definitions[t].permissions[n].expr)

    def _below(self, inside: set[Node], used: dict[str, set[str]], start: tuple[str, DataFrame]) -> DataFrame:
        """(t, id): the objects whose members those of the start rest on, by edges within the component.

        Breadth first; an object is followed once, so cycles end.
        """
        types = sorted({t for t, _ in inside})
        steps = [self.scan(t, r, None).where(F.col("subject_type").isin(types) & (F.col("subject_id") != STAR)) for t in types for r in sorted(used.get(t, ()))]
        steps = cut(_all([e.select("resource_type", "resource_id", "subject_type", "subject_id") for e in steps]).distinct()) if steps else None
        found = front = cut(start[1].select(F.lit(start[0]).alias("t"), "id").distinct())
        for _ in range(self.max_depth + 1):
            if steps is None:
                return found
            on = (F.col("resource_type") == F.col("t")) & (F.col("resource_id") == F.col("id"))
            new = steps.join(front, on, "left_semi").select(F.col("subject_type").alias("t"), F.col("subject_id").alias("id")).distinct()
            front = cut(new.join(found, ["t", "id"], "left_anti"))
            if front.isEmpty():
                return found
            found = cut(found.unionByName(front))
        raise DepthError(f"{sorted(inside)} goes deeper than {self.max_depth}")

    def fixpoint(self, inside: set[Node], start: tuple[str, DataFrame] | None = None) -> dict[Node, DataFrame]:
        """Member tables of a component's nodes; with a start (type, ids), of the objects that it reaches."""
        before, self.kept = self.kept, dict(self.kept)
        try:
            return self._fixpoint(inside, start)
        finally:
            if start is not None:  # edges were kept for these objects only
                self.kept = before

    def _fixpoint(self, inside: set[Node], start: tuple[str, DataFrame] | None) -> dict[Node, DataFrame]:
        self._stratified(inside)
        nodes = sorted(n for n in inside if reaches(self.schema, n, self.subject))
        wild = self.wild(nodes)
        env: dict = {n: self.empty() for n in inside}
        used: dict[str, set[str]] = {}
        for t, n in nodes:
            d = self.schema.definitions[t]
            used.setdefault(t, set()).update([n] if n in d.relations else [e.relation for e in parts_of(d.permissions[n].expr) if isinstance(e, Arrow)])
        reach = None if start is None else self._below(inside, used, start)
        # every ply reads these edges again: filtered and pruned once, not derived each time
        for t, r in ((t, r) for t, rs in used.items() for r in sorted(rs)):
            if start is not None:
                ids = reach.where(F.col("t") == t).select("id")
                self.kept[t, r] = cut(self.scan(t, r, ids))
            elif (t, r) not in self.kept:
                self.kept[t, r] = cut(self.scan(t, r, None))
        if wild or not self._union_only(inside):
            return self._naive(nodes, env)
        plies = {n: [cut(self.body(n, env, frozenset(), None))] for n in nodes}
        delta, depth = {n: p[0] for n, p in plies.items()}, 0
        while delta:
            depth += 1
            if depth > self.max_depth:
                raise DepthError(f"{nodes} has not settled after {self.max_depth} plies")
            step, fresh = env | delta, {}
            for n in nodes:
                new = self.body(n, step, frozenset(delta), None)
                old = _all(plies[n]).select(F.col("resource").alias("r2"), F.col("subject").alias("s2"), F.col("state").alias("st2"))
                same = (F.col("resource") == F.col("r2")) & (F.col("subject") == F.col("s2")) & (F.col("state") <= F.col("st2"))
                new = cut(new.join(old, same, "left_anti"))
                if not new.isEmpty():
                    fresh[n] = new
            for n, new in fresh.items():
                plies[n].append(new)
                if len(plies[n]) > 12:  # keeps plans short
                    plies[n] = [cut(merge(_all(plies[n]), False))]
            delta = fresh
        return env | {n: merge(_all(p), False) for n, p in plies.items()}

    def _naive(self, nodes: list[Node], env: dict) -> dict[Node, DataFrame]:
        """All of each node again from the last ply, until counts and hashes stay."""
        before = None
        for _ in range(self.max_depth + 1):
            env = env | {n: cut(self.body(n, env, frozenset(), None)) for n in nodes}
            now = [tuple(env[n].agg(F.count(F.lit(1)), F.sum(F.xxhash64("resource", "subject", "state", "w").cast("decimal(38,0)"))).first()) for n in nodes]
            if now == before:
                return env
            before = now
        raise DepthError(f"{nodes} has not settled after {self.max_depth} plies")

    def members(self, node: Node, seed: DataFrame | None = None) -> DataFrame:
        """The member table of type and permission; seed (a column id) restricts its objects."""
        t, n = node
        if t not in self.schema.definitions or not self.schema.definitions[t].has(n):
            raise ValueError(f"no relation or permission {t}#{n}")
        self.narrow = seed is not None
        out = self.node(node, {}, frozenset(), seed)
        if seed is not None:
            out = out.join(seed.select(F.col("id").alias("resource")), "resource", "left_semi")
        return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
