"""A second, independent evaluator: three-valued least fixpoint over Python dicts."""

import json

from permspark.functions.caveats import evaluate
from permspark.plans.dsl import Arrow, Nil, Op, Ref, Self
from permspark.sources.text import parse_edge


class Naive:
    def __init__(self, schema, lines, context=None, as_of=None):
        self.schema, self.edges = schema, []
        for line in lines:
            e = parse_edge(line)
            if as_of and e[8] and e[8] <= as_of:
                continue
            state = 2
            if e[6]:
                state = evaluate(schema.caveats[e[6]], json.loads(e[7]) if e[7] else {}, context or {})[0]
            self.edges.append((*e[:6], state))
        self.objects = {(e[0], e[1]) for e in self.edges} | {(e[3], e[4]) for e in self.edges if e[4] != "*"}

    def table(self, subject):
        """State of every (type, id, name) for one subject (type, id, relation)."""
        now = {}
        while True:
            new = {}
            for t, i in self.objects | {subject[:2]}:
                d = self.schema.definitions[t]
                for r in d.relations:
                    new[t, i, r] = self.relation(t, i, r, subject, now)
                for p in d.permissions.values():
                    new[t, i, p.name] = max(self.expr(t, i, p.expr, subject, now), 2 if (t, i, p.name) == subject else 0)
            if new == now:
                return now
            now = new

    def relation(self, t, i, r, s, now):
        best = 2 if (t, i, r) == s else 0
        for rt, ri, rr, st, si, sr, state in self.edges:
            if (rt, ri, rr) != (t, i, r):
                continue
            if (st, si, sr) == s or (si == "*" and st == s[0] and s[2] == "..."):
                best = max(best, state)
            elif sr != "...":
                best = max(best, min(state, now.get((st, si, sr), 0)))
        return best

    def expr(self, t, i, e, s, now):
        match e:
            case Nil():
                return 0
            case Self():
                return 2 if s == (t, i, "...") else 0
            case Ref(name):
                return now.get((t, i, name), 0)
            case Op("+", parts):
                return max(self.expr(t, i, p, s, now) for p in parts)
            case Op("&", parts):
                return min(self.expr(t, i, p, s, now) for p in parts)
            case Op("-", (a, b)):
                return min(self.expr(t, i, a, s, now), 2 - self.expr(t, i, b, s, now))
            case Arrow(rel, target, every):
                hits = [min(e[6], now.get((e[3], e[4], target), 0)) for e in self.edges if e[:3] == (t, i, rel)]
                return (min(hits) if every else max(hits)) if hits else 0
        raise TypeError(e)
