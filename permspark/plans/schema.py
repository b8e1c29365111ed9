"""Checks and analyses of a schema; all on the driver, none reads data."""

from __future__ import annotations

from collections.abc import Iterator

from permspark.plans.dsl import AllowedType, Arrow, Nil, Op, Ref, Schema, SchemaError, Self, generate, parse, show, show_allowed

Node = tuple[str, str]  # type, relation or permission


def parts_of(e) -> Iterator[object]:
    """All leaves of an expression."""
    if isinstance(e, Op):
        for p in e.parts:
            yield from parts_of(p)
    else:
        yield e


def validate(s: Schema) -> Schema:
    """Raises SchemaError unless all that is referred to exists and is allowed there."""
    for c in s.caveats.values():
        from permspark.functions.cel import names_in

        unused = set(c.params) - names_in(c.expr)
        if unused:
            raise SchemaError(f"caveat {c.name}: parameters {sorted(unused)} are unused")
    for d in s.definitions.values():
        for r in d.relations.values():
            seen = set()
            for a in r.allowed:
                if a in seen:
                    raise SchemaError(f"{d.name}#{r.name}: {show_allowed(a)} is listed twice")
                seen.add(a)
                target = s.definitions.get(a.type)
                if target is None:
                    raise SchemaError(f"{d.name}#{r.name}: no type {a.type!r}")
                if a.relation != "..." and not target.has(a.relation):
                    raise SchemaError(f"{d.name}#{r.name}: no relation {a.type}#{a.relation}")
                if a.relation != "..." and wildcard_in(s, (a.type, a.relation), direct=True):
                    raise SchemaError(f"{d.name}#{r.name}: {a.type}#{a.relation} has a wildcard")
                if a.caveat and a.caveat not in s.caveats:
                    raise SchemaError(f"{d.name}#{r.name}: no caveat {a.caveat!r}")
                if a.expiration and "expiration" not in s.flags:
                    raise SchemaError(f"{d.name}#{r.name}: expiration is not in use")
        for p in d.permissions.values():
            for e in parts_of(p.expr):
                match e:
                    case Ref(name):
                        if not d.has(name):
                            raise SchemaError(f"{d.name}#{p.name}: no relation or permission {name!r}")
                    case Arrow(relation, target, _):
                        if relation in d.permissions:
                            raise SchemaError(f"{d.name}#{p.name}: {relation} is a permission, left of an arrow")
                        if relation not in d.relations:
                            raise SchemaError(f"{d.name}#{p.name}: no relation {relation!r}")
                        allowed = d.relations[relation].allowed
                        if any(a.wildcard for a in allowed):
                            raise SchemaError(f"{d.name}#{p.name}: {relation} has a wildcard, left of an arrow")
                        if not any(s.definitions[a.type].has(target) for a in allowed if a.type in s.definitions):
                            raise SchemaError(f"{d.name}#{p.name}: no type of {relation} has {target!r}")
        for p in d.permissions:
            _no_ref_cycle(s, d.name, p)
    return s


def _no_ref_cycle(s: Schema, type_: str, start: str) -> None:
    """A permission may not rest on itself on the same object."""
    todo, seen = [start], set()
    while todo:
        p = s.definitions[type_].permissions.get(todo.pop())
        for e in parts_of(p.expr) if p else ():
            if isinstance(e, Ref):
                if e.name == start:
                    raise SchemaError(f"{type_}#{start} rests on itself")
                if e.name not in seen:
                    seen.add(e.name)
                    todo.append(e.name)


def load(text: str, importer=None) -> Schema:
    return validate(parse(text, importer))


def edges(s: Schema, node: Node) -> set[Node]:
    """Nodes that a node's members are computed from."""
    type_, name = node
    d = s.definitions[type_]
    if name in d.relations:
        return {(a.type, a.relation) for a in d.relations[name].allowed if a.relation != "..."}
    out = set()
    for e in parts_of(d.permissions[name].expr):
        match e:
            case Ref(n):
                out.add((type_, n))
            case Arrow(rel, target, _):
                out |= {(a.type, target) for a in d.relations[rel].allowed if s.definitions[a.type].has(target)}
    return out


def closure(s: Schema, node: Node) -> set[Node]:
    """The node and all it rests on."""
    seen, todo = {node}, [node]
    while todo:
        for n in edges(s, todo.pop()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def component(s: Schema, node: Node) -> set[Node]:
    """The strongly connected component of a node; empty unless it rests on itself."""
    inside = {n for n in closure(s, node) if node in closure(s, n)} if any(node in closure(s, n) for n in edges(s, node)) else set()
    return inside


def wildcard_in(s: Schema, node: Node, direct: bool = False, subject_type: str | None = None) -> bool:
    """Whether a wildcard can be among a node's members."""
    type_, name = node
    nodes = {node} if direct else closure(s, node)
    for t, n in nodes:
        r = s.definitions[t].relations.get(n)
        if r and any(a.wildcard and subject_type in (None, a.type) for a in r.allowed):
            return True
    return False


def subject_types(s: Schema, node: Node) -> set[tuple[str, str]]:
    """(type, relation) of all subjects that can be members; '*' for wildcards."""
    out = set()
    for t, n in closure(s, node):
        d = s.definitions[t]
        if n in d.relations:
            out |= {(a.type, "*" if a.wildcard else a.relation) for a in d.relations[n].allowed}
        elif any(isinstance(e, Self) for e in parts_of(d.permissions[n].expr)):
            out.add((t, "..."))
    return out


def reaches(s: Schema, node: Node, subject: tuple[str, str]) -> bool:
    """Whether a subject of this type and relation can be a member at all."""
    found = subject_types(s, node)
    return subject in found or (subject[1] == "..." and (subject[0], "*") in found) or subject in closure(s, node)


# --- simplification -------------------------------------------------------------


def simplify(s: Schema, type_: str, e, subject: tuple[str, str] | None = None):
    """An equivalent expression: set laws, nil, and branches that the subject type can't reach.

    The left side of an arrow is never pruned, and the subtracted side only if it is nil.
    """
    match e:
        case Op(op, parts):
            parts = [simplify(s, type_, p, subject) for p in parts]
            if op == "-":
                a, b = parts
                if isinstance(a, Nil) or a == b:
                    return Nil()
                if isinstance(b, Nil):
                    return a
                if isinstance(b, Op) and b.op == "+" and a in b.parts:
                    return Nil()
                return Op("-", (a, b))
            flat: list = []
            for p in parts:
                for q in p.parts if isinstance(p, Op) and p.op == op else (p,):
                    if q not in flat:
                        flat.append(q)
            if op == "&":
                if any(isinstance(p, Nil) for p in flat):
                    return Nil()
                # absorption: a & (a + b) = a
                flat = [p for p in flat if not (isinstance(p, Op) and p.op == "+" and any(q in p.parts for q in flat if q is not p))]
                if any(isinstance(p, Op) and p.op == "-" and p.parts[1] in flat for p in flat):
                    return Nil()
            else:
                flat = [p for p in flat if not isinstance(p, Nil)]
                # absorption: a + (a & b) = a, a + (a - b) = a
                flat = [p for p in flat if not (isinstance(p, Op) and ((p.op == "&" and any(q in p.parts for q in flat if q is not p)) or (p.op == "-" and p.parts[0] in flat)))]
                if not flat:
                    return Nil()
            return flat[0] if len(flat) == 1 else Op(op, tuple(sorted(flat, key=show)))
        case Ref(name):
            return Nil() if subject and not reaches(s, (type_, name), subject) else e
        case Arrow(rel, target, every):
            nodes = [(a.type, target) for a in s.definitions[type_].relations[rel].allowed if s.definitions[a.type].has(target)]
            return Nil() if subject and not any(reaches(s, n, subject) for n in nodes) else e
    return e


# --- reflection -----------------------------------------------------------------


def reflect(s: Schema) -> list[tuple[str, str, str, str]]:
    """Rows (kind, definition, name, detail)."""
    out = [("caveat", c.name, p, t) for c in s.caveats.values() for p, t in c.params.items()]
    out += [("caveat_expression", c.name, "", c.expr) for c in s.caveats.values()]
    for d in s.definitions.values():
        out.append(("definition", d.name, "", ""))
        out += [("relation", d.name, r.name, show_allowed(a)) for r in d.relations.values() for a in r.allowed]
        out += [("permission", d.name, p.name, show(p.expr)) for p in d.permissions.values()]
    return out


def dependents(s: Schema, node: Node) -> list[Node]:
    """Relations and permissions that a permission uses, arrows' relations included."""
    out = set()
    for t, n in closure(s, node):
        out.add((t, n))
        p = s.definitions[t].permissions.get(n)
        out |= {(t, e.relation) for e in parts_of(p.expr) if isinstance(e, Arrow)} if p else set()
    return sorted(out - {node})


def computable(s: Schema, node: Node) -> list[Node]:
    """Permissions that use a relation or permission."""
    return sorted((d.name, p) for d in s.definitions.values() for p in d.permissions if (d.name, p) != node and node in dependents(s, (d.name, p)))


def referencing(s: Schema, node: Node) -> list[Node]:
    """Relations that allow subjects of type#relation."""
    return sorted((d.name, r.name) for d in s.definitions.values() for r in d.relations.values() if any((a.type, a.relation) == node for a in r.allowed))


def entrypoints(s: Schema, node: Node, subject: tuple[str, str]) -> list[tuple[str, str, str, bool]]:
    """(kind, type, name, direct) through which a subject type enters a permission.

    direct is false below ``&``, ``-`` and ``.all``, where reaching it proves nothing yet.
    """
    out, seen = set(), set()

    def walk(n: Node, direct: bool) -> None:
        if (n, direct) in seen:
            return
        seen.add((n, direct))
        t, name = n
        d = s.definitions[t]
        if name in d.relations:
            for a in d.relations[name].allowed:
                if (a.type, a.relation) == subject or (a.wildcard and subject == (a.type, "...")):
                    out.add(("relation", t, name, direct))
                if a.relation != "...":
                    walk((a.type, a.relation), direct)
            return
        visit(t, d.permissions[name].expr, direct)

    def visit(t: str, e, direct: bool) -> None:
        match e:
            case Op(op, parts):
                for p in parts if op == "+" else parts[:1]:
                    visit(t, p, direct and op == "+")
            case Ref(name):
                walk((t, name), direct)
            case Arrow(rel, target, every):
                for a in s.definitions[t].relations[rel].allowed:
                    if s.definitions[a.type].has(target) and reaches(s, (a.type, target), subject):
                        out.add(("arrow", t, f"{rel}->{target}", direct and not every))
                        walk((a.type, target), direct and not every)
            case Self():
                if subject == (t, "..."):
                    out.add(("self", t, "self", direct))

    walk(node, True)
    return sorted(out)


def diff(old: Schema, new: Schema) -> list[tuple[str, str, str, str, str]]:
    """Rows (change, kind, definition, name, detail) from old to new."""
    a, b = ({(k, d, n): [] for k, d, n, _ in reflect(x)} for x in (old, new))
    for x, into in ((old, a), (new, b)):
        for k, d, n, detail in reflect(x):
            into[k, d, n].append(detail)
    out = [("added", *k, "; ".join(sorted(b[k]))) for k in b.keys() - a.keys()]
    out += [("removed", *k, "; ".join(sorted(a[k]))) for k in a.keys() - b.keys()]
    for k in a.keys() & b.keys():
        if k[0] == "relation":
            out += [("allowed_type_added", *k, x) for x in set(b[k]) - set(a[k])] + [("allowed_type_removed", *k, x) for x in set(a[k]) - set(b[k])]
        elif sorted(a[k]) != sorted(b[k]):
            out.append(("changed", *k, f"{'; '.join(a[k])} => {'; '.join(b[k])}"))
    return sorted(out)


def lint(s: Schema) -> list[str]:
    """Warnings about what is valid yet doubtful."""
    out = []
    for d in s.definitions.values():
        for p in d.permissions.values():
            if d.name in p.name:
                out.append(f"{d.name}#{p.name}: the permission repeats the type's name")
            for e in parts_of(p.expr):
                if isinstance(e, Arrow):
                    for a in d.relations[e.relation].allowed:
                        t = s.definitions[a.type]
                        if not t.has(e.target):
                            out.append(f"{d.name}#{p.name}: {a.type} has no {e.target}")
                        elif e.target in t.relations:
                            out.append(f"{d.name}#{p.name}: {e.relation}->{e.target} points at a relation, not a permission")
                        if a.relation != "...":
                            out.append(f"{d.name}#{p.name}: the arrow ignores #{a.relation} of {a.type}")
        for r in d.relations.values():
            if d.name in r.name:
                out.append(f"{d.name}#{r.name}: the relation repeats the type's name")
    return out


__all__ = ["AllowedType", "generate", "load", "validate", "simplify", "reflect", "diff"]
