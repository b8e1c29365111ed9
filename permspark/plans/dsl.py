"""The schema language: text to definitions, and back.

Set operators are listed loosest first: ``-``, ``&``, ``+``; so ``a - b + c`` means
``a - (b + c)``. All are left-associative; arrows bind tightest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class SchemaError(ValueError):
    """The schema text, or what it declares, is not valid."""


# --- expressions ---------------------------------------------------------------


@dataclass(frozen=True)
class Ref:
    """Another relation or permission of the same object."""

    name: str


@dataclass(frozen=True)
class Arrow:
    """``rel->perm``, ``rel.any(perm)``; with every, ``rel.all(perm)``."""

    relation: str
    target: str
    every: bool = False


@dataclass(frozen=True)
class Nil:
    """Nobody."""


@dataclass(frozen=True)
class Self:
    """The object itself as a subject."""


@dataclass(frozen=True)
class Op:
    """``+``, ``&`` or ``-`` over two or more parts."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class AllowedType:
    type: str
    relation: str = "..."
    wildcard: bool = False
    caveat: str | None = None
    expiration: bool = False


@dataclass
class Relation:
    name: str
    allowed: list[AllowedType]


@dataclass
class Permission:
    name: str
    expr: object


@dataclass
class Caveat:
    name: str
    params: dict[str, str]
    expr: str


@dataclass
class Definition:
    name: str
    relations: dict[str, Relation] = field(default_factory=dict)
    permissions: dict[str, Permission] = field(default_factory=dict)
    spreads: list[str] = field(default_factory=list)

    def has(self, name: str) -> bool:
        return name in self.relations or name in self.permissions


@dataclass
class Schema:
    definitions: dict[str, Definition] = field(default_factory=dict)
    caveats: dict[str, Caveat] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)


FLAGS = {"expiration", "typechecking", "self", "partial", "import"}
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:/[A-Za-z_][A-Za-z0-9_]*)*)"
    r"|(?P<string>\"[^\"\n]*\"|'[^'\n]*')|(?P<sym>->|\.\.\.|[{}():|#*+&\-=,.<>;])",
    re.S,
)


class _Parser:
    def __init__(self, text: str, load: Callable[[str], str] | None) -> None:
        self.text, self.at, self.load = text, 0, load
        self.kind = self.value = ""
        self.start = 0
        self.next()

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.start) + 1
        raise SchemaError(f"line {line}: {what}, found {self.value or 'the end'!r}")

    def next(self) -> str:
        old = self.value
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.start, self.value = self.at, self.text[self.at]
                self.fail("unexpected character")
            self.start, self.at = self.at, m.end()
            if m.lastgroup != "space":
                self.kind, self.value = m.lastgroup, m[0]
                return old
        self.start, self.kind, self.value = self.at, "end", ""
        return old

    def take(self, value: str) -> bool:
        if self.value == value and self.kind != "string":
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def name(self) -> str:
        if self.kind != "name":
            self.fail("expected a name")
        return self.next()

    def schema(self) -> tuple[Schema, dict[str, Definition]]:
        s, partials = Schema(), {}
        while self.kind != "end":
            if self.take("use"):
                flag = self.name()
                if flag not in FLAGS:
                    raise SchemaError(f"unknown flag {flag!r}")
                s.flags.add(flag)
            elif self.take("import"):
                path = self.next().strip("\"'")
                if self.load is None:
                    raise SchemaError(f"nothing to load import {path!r} with")
                other, more = _Parser(self.load(path), self.load).schema()
                for have, new in ((s.definitions, other.definitions), (s.caveats, other.caveats), (partials, more)):
                    _add_all(have, new)
                s.flags |= other.flags
            elif self.take("caveat"):
                c = self.caveat()
                _add_all(s.caveats, {c.name: c})
            elif self.value in ("definition", "partial"):
                into = s.definitions if self.next() == "definition" else partials
                d = self.definition()
                _add_all(into, {d.name: d})
            else:
                self.fail("expected definition, caveat, partial, import or use")
        return s, partials

    def caveat(self) -> Caveat:
        name, params = self.name(), {}
        self.need("(")
        while not self.take(")"):
            p = self.name()
            if p in params:
                raise SchemaError(f"caveat {name}: parameter {p} appears twice")
            params[p] = self.param_type()
            self.take(",")
        if self.value != "{":
            self.fail("expected '{'")
        # the body is another language: find its closing brace, strings aside
        depth, i, quote = 0, self.start, ""
        while i < len(self.text):
            ch = self.text[i]
            if quote:
                if ch == "\\":
                    i += 1
                elif ch == quote:
                    quote = ""
            elif ch in "\"'":
                quote = ch
            elif ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        else:
            raise SchemaError(f"caveat {name}: no closing brace")
        body = self.text[self.start + 1 : i].strip()
        self.at = i + 1
        self.next()
        if not params:
            raise SchemaError(f"caveat {name} has no parameters")
        if not body:
            raise SchemaError(f"caveat {name} has no expression")
        return Caveat(name, params, body)

    def param_type(self) -> str:
        t = self.name()
        if self.take("<"):
            t += f"<{self.param_type()}>"
            self.need(">")
        return t

    def definition(self) -> Definition:
        d = Definition(self.name())
        self.need("{")
        while not self.take("}"):
            if self.take("..."):
                d.spreads.append(self.name())
            elif self.take("relation"):
                name = self.name()
                self.need(":")
                allowed = [self.allowed()]
                while self.take("|"):
                    allowed.append(self.allowed())
                _unique(d, name)
                d.relations[name] = Relation(name, allowed)
            elif self.take("permission"):
                name = self.name()
                if self.take(":"):  # an optional type annotation
                    self.name()
                    while self.take("|"):
                        self.name()
                self.need("=")
                expr = self.expr()
                _unique(d, name)
                d.permissions[name] = Permission(name, expr)
            else:
                self.fail("expected relation or permission")
            self.take(";")
        return d

    def allowed(self) -> AllowedType:
        type_, relation, wildcard, caveat, expiration = self.name(), "...", False, None, False
        if self.take(":"):
            self.need("*")
            wildcard = True
        elif self.take("#"):
            relation = "..." if self.take("...") else self.name()
        if self.take("with"):
            first = self.name()
            if first == "expiration":
                expiration = True
            else:
                caveat = first
                if self.take("and"):
                    if self.name() != "expiration":
                        self.fail("expected expiration")
                    expiration = True
        return AllowedType(type_, relation, wildcard, caveat, expiration)

    def expr(self, level: int = 0):
        if level == 3:
            return self.term()
        op = "-&+"[level]
        parts = [self.expr(level + 1)]
        while self.take(op):
            parts.append(self.expr(level + 1))
        if len(parts) == 1:
            return parts[0]
        if op == "-":  # binary, from the left
            out = parts[0]
            for p in parts[1:]:
                out = Op("-", (out, p))
            return out
        return Op(op, tuple(parts))

    def term(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        name = self.name()
        if name == "nil":
            return Nil()
        if name == "self" and self.value not in ("->", "."):
            return Self()
        if self.take("->"):
            return Arrow(name, self.name())
        if self.take("."):
            how = self.name()
            if how not in ("any", "all"):
                self.fail("expected any or all")
            self.need("(")
            target = self.name()
            self.need(")")
            return Arrow(name, target, how == "all")
        return Ref(name)


def _unique(d: Definition, name: str) -> None:
    if d.has(name):
        raise SchemaError(f"{d.name}: {name} is declared twice")


def _add_all(have: dict, new: dict) -> None:
    for k, v in new.items():
        if k in have:
            raise SchemaError(f"{k} is declared twice")
        have[k] = v


def parse(text: str, load: Callable[[str], str] | None = None) -> Schema:
    """Schema of a text, partials spread and imports loaded; not yet validated."""
    s, partials = _Parser(text, load).schema()
    done: set[str] = set()

    def spread(d: Definition, path: tuple[str, ...]) -> None:
        if d.name in path:
            raise SchemaError(f"partials form a cycle at {d.name}")
        for p in d.spreads:
            if p not in partials:
                raise SchemaError(f"{d.name}: no partial {p!r}")
            if p not in done:
                spread(partials[p], (*path, d.name))
                done.add(p)
            for r in partials[p].relations.values():
                _unique(d, r.name)
                d.relations[r.name] = r
            for q in partials[p].permissions.values():
                _unique(d, q.name)
                d.permissions[q.name] = q

    for d in s.definitions.values():
        spread(d, ())
    return s


# --- back to text ----------------------------------------------------------------

_LEVEL = {"-": 0, "&": 1, "+": 2}


def show(e, level: int = 0) -> str:
    """An expression as text that parses to the same expression."""
    match e:
        case Ref(name):
            return name
        case Arrow(relation, target, every):
            return f"{relation}.all({target})" if every else f"{relation}->{target}"
        case Nil():
            return "nil"
        case Self():
            return "self"
        case Op(op, parts):
            own = _LEVEL[op]
            text = f" {op} ".join(show(p, own if i == 0 and op == "-" else own + 1) for i, p in enumerate(parts))
            return f"({text})" if own < level else text
    raise TypeError(e)


def show_allowed(a: AllowedType) -> str:
    out = f"{a.type}:*" if a.wildcard else a.type if a.relation == "..." else f"{a.type}#{a.relation}"
    traits = [x for x in (a.caveat, "expiration" if a.expiration else None) if x]
    return out + (f" with {' and '.join(traits)}" if traits else "")


def generate(s: Schema) -> str:
    """Schema text."""
    out = [f"use {f}" for f in sorted(s.flags - {"partial", "import"})]
    for c in s.caveats.values():
        out.append(f"caveat {c.name}({', '.join(f'{k} {v}' for k, v in c.params.items())}) {{\n\t{c.expr}\n}}")
    for d in s.definitions.values():
        body = [f"\trelation {r.name}: {' | '.join(map(show_allowed, r.allowed))}" for r in d.relations.values()]
        body += [f"\tpermission {p.name} = {show(p.expr)}" for p in d.permissions.values()]
        out.append(f"definition {d.name} {{" + ("\n" + "\n".join(body) + "\n}" if body else "}"))
    return "\n\n".join(out) + "\n"
