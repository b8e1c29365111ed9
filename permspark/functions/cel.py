"""Boolean caveat expressions: parser and three-valued evaluator.

A parameter without a value is *unknown*; an expression is unknown if an unknown decides
it. ``&&`` and ``||`` are commutative: a side that decides absorbs errors and unknowns
of the other.
"""

from __future__ import annotations

import base64
import functools
import ipaddress
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta


class CelError(ValueError):
    """The expression or a value in it is not valid."""


@dataclass(frozen=True)
class Unknown:
    names: frozenset[str]


_TOKEN = re.compile(
    r"\s+|//[^\n]*|(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0x[0-9a-fA-F]+u?|\d+u?)"
    r"|(?P<str>[rRbB]?(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>!?:.,()\[\]{}])"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "`": "`", "?": "?", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_BINARY = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%")]
MACROS = {"all", "exists", "exists_one", "map", "filter"}


def _string(token: str):
    raw, body = token[0] in "rR", token[token.index(token[-1]) + 1 : -1]
    kind_bytes = token[0] in "bB"
    text = body if raw else re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body)
    return text.encode() if kind_bytes else text


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CelError(f"unexpected {text[at]!r} in {text!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    @property
    def value(self) -> str:
        return self.tokens[self.i][1] if self.tokens[self.i][0] != "str" else ""

    def take(self, v: str) -> bool:
        if self.value == v and v:
            self.i += 1
            return True
        return False

    def need(self, v: str) -> None:
        if not self.take(v):
            raise CelError(f"expected {v!r}, found {self.tokens[self.i][1]!r}")

    def expr(self):
        e = self.binary(0)
        if self.take("?"):
            a = self.expr()
            self.need(":")
            return ("if", e, a, self.expr())
        return e

    def binary(self, level: int):
        if level == len(_BINARY):
            return self.unary()
        e = self.binary(level + 1)
        while self.value in _BINARY[level]:
            op = self.tokens[self.i][1]
            self.i += 1
            e = ("op", op, e, self.binary(level + 1))
        return e

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.take("-"):
            return ("neg", self.unary())
        return self.member()

    def member(self):
        e = self.primary()
        while True:
            if self.take("."):
                optional = self.take("?")
                name = self.tokens[self.i][1]
                self.i += 1
                e = ("call", name, e, self.args()) if self.take("(") else ("field", e, name, optional)
            elif self.take("?"):
                # a?.b ; anything else is a conditional
                if self.value != ".":
                    self.i -= 1
                    return e
                self.need(".")
                e = ("field", e, self.tokens[self.i][1], True)
                self.i += 1
            elif self.take("["):
                e = ("index", e, self.expr())
                self.need("]")
            else:
                return e

    def args(self) -> list:
        out = []
        while not self.take(")"):
            out.append(self.expr())
            if not self.take(","):
                self.need(")")
                break
        return out

    def primary(self):
        kind, v = self.tokens[self.i]
        self.i += 1
        if kind == "int":
            return ("lit", int(v.rstrip("u"), 0))
        if kind == "float":
            return ("lit", float(v))
        if kind == "str":
            return ("lit", _string(v))
        if kind == "name":
            if v in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[v])
            return ("call", v, None, self.args()) if self.take("(") else ("name", v)
        if v == "(":
            e = self.expr()
            self.need(")")
            return e
        if v == "[":
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if v == "{":
            items = []
            while not self.take("}"):
                k = self.expr()
                self.need(":")
                items.append((k, self.expr()))
                self.take(",")
            return ("map", items)
        raise CelError(f"unexpected {v!r}")


@functools.lru_cache(1000)
def parse(text: str):
    p = _Parser(text)
    e = p.expr()
    if p.tokens[p.i][0] != "end":
        raise CelError(f"unexpected {p.tokens[p.i][1]!r} in {text!r}")
    return e


def names_in(text: str) -> set[str]:
    """Names that an expression refers to, without those its macros bind."""

    def walk(e, bound: frozenset) -> set[str]:
        match e:
            case ("name", n):
                return set() if n in bound else {n}
            case ("call", f, target, args):
                out = walk(target, bound) if target else set()
                inner = bound | {args[0][1]} if f in MACROS and target and args and args[0][0] == "name" else bound
                for a in args[1:] if inner is not bound else args:
                    out |= walk(a, inner)
                return out
            case ("list", items):
                return set().union(*(walk(i, bound) for i in items))
            case ("map", items):
                return set().union(*(walk(x, bound) for kv in items for x in kv))
            case tuple():
                return set().union(*(walk(x, bound) for x in e[1:] if isinstance(x, tuple)))
        return set()

    return walk(parse(text), frozenset())


# --- values ------------------------------------------------------------------------

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def duration(text: str) -> timedelta:
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:h|ms|us|µs|ns|m|s))+|0)", text)
    if not m:
        raise CelError(f"not a duration: {text!r}")
    parts = re.findall(r"(\d+(?:\.\d*)?)(h|ms|us|µs|ns|m|s)", m[2])
    total = timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in parts))
    return -total if m[1] == "-" else total


def timestamp(text: str) -> datetime:
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise CelError(f"not a timestamp: {text!r}") from e
    return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)


def ip(text: str):
    try:
        a = ipaddress.ip_address(text)
    except ValueError as e:
        raise CelError(f"not an IP address: {text!r}") from e
    return getattr(a, "ipv4_mapped", None) or a


def coerce(value, kind: str):
    """A JSON value as a value of a parameter type."""
    base, _, inner = kind.partition("<")
    inner = inner[:-1]
    want = lambda ok: ok or _bad(value, kind)
    if base == "any":
        return value
    if base in ("bool", "string"):
        want(isinstance(value, bool if base == "bool" else str))
        return value
    if base in ("int", "uint"):
        want(not isinstance(value, bool) and isinstance(value, int | float | str))
        try:
            n = int(value) if isinstance(value, int | str) else int(value) if value == int(value) else _bad(value, kind)
        except ValueError:
            _bad(value, kind)
        want(base == "int" or n >= 0)
        return n
    if base == "double":
        want(not isinstance(value, bool) and isinstance(value, int | float | str))
        try:
            return float(value)
        except ValueError:
            _bad(value, kind)
    if base == "list":
        want(isinstance(value, list))
        return [coerce(v, inner or "any") for v in value]
    if base == "map":
        want(isinstance(value, dict))
        return {k: coerce(v, inner or "any") for k, v in value.items()}
    want(isinstance(value, str))
    if base == "bytes":
        try:
            return base64.b64decode(value, validate=True)
        except ValueError:
            _bad(value, kind)
    makers = {"duration": duration, "timestamp": timestamp, "ipaddress": ip}
    if base not in makers:
        raise CelError(f"unknown type {kind!r}")
    return makers[base](value)


def _bad(value, kind: str):
    raise CelError(f"{value!r} is not a value of type {kind}")


# --- evaluation -----------------------------------------------------------------


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _equal(a, b) -> bool:
    if _number(a) and _number(b):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


def _arith(op: str, a, b):
    if op == "+" and type(a) is type(b) and isinstance(a, str | list | bytes):
        return a + b
    if isinstance(a, datetime | timedelta) or isinstance(b, datetime | timedelta):
        return a + b if op == "+" else a - b if op == "-" else _bad(op, "time operator")
    if not (_number(a) and _number(b)) or isinstance(a, float) != isinstance(b, float):
        raise CelError(f"no {op} for {a!r} and {b!r}")
    if op in "/%" and b == 0 and not isinstance(a, float):
        raise CelError("division by zero")
    if op == "/":
        return a / b if isinstance(a, float) else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    if op == "%":
        return abs(a) % abs(b) * (-1 if a < 0 else 1)
    out = a + b if op == "+" else a - b if op == "-" else a * b
    if isinstance(out, int) and not -(2**63) <= out < 2**63:
        raise CelError("integer overflow")
    return out


def _subtree(a: dict, b: dict) -> bool:
    return all(k in b and (_subtree(v, b[k]) if isinstance(v, dict) and isinstance(b[k], dict) else _equal(v, b[k])) for k, v in a.items())


_ACCESS = {
    "getFullYear": lambda t: t.year, "getMonth": lambda t: t.month - 1, "getDate": lambda t: t.day, "getDayOfMonth": lambda t: t.day - 1,
    "getDayOfWeek": lambda t: t.isoweekday() % 7, "getDayOfYear": lambda t: t.timetuple().tm_yday - 1, "getMilliseconds": lambda t: t.microsecond // 1000,
    "getHours": lambda t: t.hour if isinstance(t, datetime) else int(t.total_seconds() // 3600),
    "getMinutes": lambda t: t.minute if isinstance(t, datetime) else int(t.total_seconds() // 60),
    "getSeconds": lambda t: t.second if isinstance(t, datetime) else int(t.total_seconds()),
}
_METHODS = {
    "size": lambda x: len(x), "contains": lambda a, b: b in a, "startsWith": lambda a, b: a.startswith(b), "endsWith": lambda a, b: a.endswith(b),
    "matches": lambda a, b: re.search(b, a) is not None, "in_cidr": lambda a, b: a in ipaddress.ip_network(b), "isSubtreeOf": _subtree,
}
_CONVERT = {
    "int": lambda x: int(x.timestamp()) if isinstance(x, datetime) else int(x), "uint": lambda x: int(x) if int(x) >= 0 else _bad(x, "uint"), "double": float,
    "string": lambda x: x if isinstance(x, str) else x.decode() if isinstance(x, bytes) else str(x).lower() if isinstance(x, bool) else str(x),
    "bytes": lambda x: x.encode() if isinstance(x, str) else x, "bool": lambda x: x if isinstance(x, bool) else {"true": True, "false": False}[x],
    "duration": duration, "timestamp": timestamp, "dyn": lambda x: x, "ipaddress": ip, "type": lambda x: type(x).__name__,
}


def _all_known(values: list) -> Unknown | None:
    names = frozenset().union(*(v.names for v in values if isinstance(v, Unknown)))
    return Unknown(names) if names else None


def _logic(decides: bool, sides) -> object:
    """``||`` (decides True) or ``&&`` (False) over lazily evaluated sides."""
    unknown, error = frozenset(), None
    for side in sides:
        try:
            v = side()
        except CelError as e:
            error = error or e
            continue
        if isinstance(v, Unknown):
            unknown |= v.names
        elif not isinstance(v, bool):
            error = error or CelError(f"{v!r} is not a bool")
        elif v == decides:
            return decides
    if unknown:
        return Unknown(unknown)
    if error:
        raise error
    return not decides


def evaluate(e, env: dict):
    """The value of a parsed expression; names without a value in env are unknown."""
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "name":
        return env[e[1]] if e[1] in env else Unknown(frozenset([e[1]]))
    if kind == "op" and e[1] in ("&&", "||"):
        return _logic(e[1] == "||", [functools.partial(evaluate, x, env) for x in e[2:]])
    if kind == "if":
        c = evaluate(e[1], env)
        return c if isinstance(c, Unknown) else evaluate(e[2] if c else e[3], env)
    if kind == "call" and e[2] is not None and e[1] in MACROS and e[3] and e[3][0][0] == "name":
        return _macro(e[1], evaluate(e[2], env), e[3], env)
    if kind == "call" and e[1] == "has":
        f = e[3][0]
        target = evaluate(f[1], env)
        return target if isinstance(target, Unknown) else f[2] in target
    subs = {"op": lambda: e[2:], "not": lambda: e[1:], "neg": lambda: e[1:], "field": lambda: [e[1]], "index": lambda: e[1:], "list": lambda: e[1], "map": lambda: [x for kv in e[1] for x in kv], "call": lambda: ([e[2]] if e[2] is not None else []) + e[3]}[kind]()
    v = [evaluate(x, env) for x in subs]
    if (u := _all_known(v)) is not None:
        return u
    try:
        return _apply(e, v)
    except CelError:
        raise
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError, re.error) as x:
        raise CelError(f"{type(x).__name__}: {x}") from x


def _apply(e, v: list):
    match e[0]:
        case "not":
            return not v[0] if isinstance(v[0], bool) else _bad(v[0], "bool")
        case "neg":
            return -v[0]
        case "list":
            return v
        case "map":
            return dict(zip(v[::2], v[1::2], strict=True))
        case "field":
            return v[0].get(e[2]) if e[3] else v[0][e[2]]
        case "index":
            return v[0][v[1]] if not isinstance(v[0], list) or v[1] >= 0 else _bad(v[1], "index")
        case "op":
            op = e[1]
            if op in ("==", "!="):
                return _equal(*v) == (op == "==")
            if op == "in":
                return v[0] in v[1] if isinstance(v[1], dict) else any(_equal(v[0], x) for x in v[1])
            if op in ("<", "<=", ">", ">="):
                if not (_number(v[0]) and _number(v[1])) and type(v[0]) is not type(v[1]):
                    raise CelError(f"no {op} for {v[0]!r} and {v[1]!r}")
                return {"<": v[0] < v[1], "<=": v[0] <= v[1], ">": v[0] > v[1], ">=": v[0] >= v[1]}[op]
            return _arith(op, *v)
    f = e[1]
    table = _ACCESS if f in _ACCESS and e[2] is not None else _METHODS if f in _METHODS else _CONVERT if e[2] is None else {}
    if f not in table:
        raise CelError(f"no function {f!r}")
    return table[f](*v)


def _macro(name: str, target, args: list, env: dict):
    if isinstance(target, Unknown):
        return target
    var = args[0][1]
    each = [functools.partial(lambda x, i: evaluate(args[i], env | {var: x}), x) for x in target]
    if name in ("all", "exists"):
        return _logic(name == "exists", [functools.partial(f, 1) for f in each])
    v = [f(1) for f in each]
    if (u := _all_known(v)) is not None:
        return u
    if name == "exists_one":
        return sum(x is True for x in v) == 1
    if name == "filter":
        return [x for x, keep in zip(target, v, strict=True) if keep is True]
    return v
