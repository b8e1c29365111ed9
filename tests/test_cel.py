import pytest

from permspark.functions import cel
from permspark.functions.caveats import evaluate
from permspark.plans.dsl import Caveat


def run(text, **env):
    return cel.evaluate(cel.parse(text), env)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3 == 7", True), ("-7 / 2 == -3 && -7 % 2 == -1", True), ("'a' + 'b' == \"ab\"", True), ("2 in [1, 2]", True), ("'k' in {'k': 1}", True),
        ("[1, 2, 3].exists(i, i > 2)", True), ("[1, 2].all(i, i > 1)", False), ("[1, 2].exists_one(i, i == 2)", True), ("[1, 2].map(i, i * 2) == [2, 4]", True), ("[1, 2].filter(i, i > 1) == [2]", True),
        ("size('abc') == 3 && 'abc'.startsWith('a') && 'abc'.endsWith('c') && 'abc'.contains('b') && 'abc'.matches('^a.c$')", True),
        ("true || 1 / 0 == 1", True), ("1 / 0 == 1 && false", False), ("1 == 1 ? 'x' == 'x' : false", True), ("!(1 > 2)", True), ("has({'a': 1}.a)", True), ("{'a': 1}.a == 1", True),
        ("timestamp('2024-03-01T10:00:00Z').getMonth() == 2", True), ("timestamp('2024-03-01T10:00:00Z') + duration('1h30m') == timestamp('2024-03-01T11:30:00Z')", True),
        ("timestamp('2024-03-03T10:00:00Z').getDayOfWeek() == 0", True), ("int('4') == 4 && string(4) == '4' && double('1.5') == 1.5", True), ("1.0 == 1", True), ("[0, 1][1] == 1", True),
    ],
)
def test_values(text, want):
    assert run(text) is want


def test_unknowns():
    assert run("a && false") is False
    assert run("a || true") is True
    assert run("a == 1 && b == 2", a=1) == cel.Unknown(frozenset(["b"]))
    assert run("[1].all(i, i > x)") == cel.Unknown(frozenset(["x"]))


def test_errors():
    for text in ("1 / 0 == 1", "1 + 'a' == 2", "[1][3] == 1", "9223372036854775807 + 1 == 0"):
        with pytest.raises(cel.CelError):
            run(text)
    with pytest.raises(cel.CelError):
        cel.parse("1 +")


def test_types():
    c = Caveat("net", {"address": "ipaddress", "cidr": "string"}, "address.in_cidr(cidr)")
    assert evaluate(c, {"cidr": "10.0.0.0/8"}, {"address": "10.2.3.4"}) == (2, [])
    assert evaluate(c, {"cidr": "10.0.0.0/8"}, {"address": "::ffff:10.2.3.4"}) == (2, [])
    assert evaluate(c, {"cidr": "10.0.0.0/8"}, {}) == (1, ["address"])
    m = Caveat("sub", {"have": "map<any>", "want": "map<any>"}, "want.isSubtreeOf(have)")
    assert evaluate(m, {"have": {"a": {"b": 1, "c": 2}}}, {"want": {"a": {"b": 1}}}) == (2, [])
    n = Caveat("num", {"nnn": "int"}, "nnn == 42")
    assert evaluate(n, {"nnn": 42}, {"nnn": 41})[0] == 2  # what is stored wins
    assert evaluate(n, {}, {"nnn": "42"})[0] == 2
    with pytest.raises(cel.CelError):
        evaluate(n, {"nnn": 1.5}, {})
    with pytest.raises(cel.CelError):
        cel.coerce(-1, "uint")
    assert cel.duration("1h30m").total_seconds() == 5400
    assert cel.names_in("some.all(i, i > x) && y == 1") == {"some", "x", "y"}
