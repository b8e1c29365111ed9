import pytest

from permspark.plans.dsl import Arrow, Op, Ref, SchemaError, generate, parse, show
from permspark.plans.schema import computable, dependents, diff, entrypoints, lint, load, simplify, subject_types

BASE = "definition user {}\ndefinition doc { relation aaa: user\n relation bbb: user\n relation ccc: user\n permission ppp = %s }"


def expr(text):
    return parse(BASE % text).definitions["doc"].permissions["ppp"].expr


def test_plus_binds_tightest():
    a, b, c = Ref("aaa"), Ref("bbb"), Ref("ccc")
    assert expr("aaa - bbb + ccc") == Op("-", (a, Op("+", (b, c))))
    assert expr("aaa & bbb + ccc") == Op("&", (a, Op("+", (b, c))))
    assert expr("aaa - bbb & ccc") == Op("-", (a, Op("&", (b, c))))
    assert expr("aaa - bbb - ccc") == Op("-", (Op("-", (a, b)), c))
    assert expr("(aaa - bbb) + ccc") == Op("+", (Op("-", (a, b)), c))


def test_arrows():
    assert expr("aaa->view + bbb.any(view) + ccc.all(view)") == Op("+", (Arrow("aaa", "view"), Arrow("bbb", "view"), Arrow("ccc", "view", True)))


@pytest.mark.parametrize("text", ["aaa - bbb + ccc", "(aaa - bbb) + ccc", "aaa - (bbb - ccc)", "(aaa & bbb) + nil", "aaa.all(view) & self"])
def test_show_parses_back(text):
    assert expr(show(expr(text))) == expr(text)


def test_generate_parses_back():
    text = """use expiration
    caveat odd(nnn int) { nnn % 2 == 1 }
    definition user {}
    definition org/team { relation member: user | user:* with odd | org/team#member with odd and expiration
      permission all_members = member - member }"""
    s = parse(text)
    assert parse(generate(s)) == s


def test_partials_and_imports():
    s = load("use partial\nuse import\nimport \"base\"\npartial common { relation owner: user }\ndefinition doc { ...common\n permission own = owner }", {"base": "definition user {}"}.__getitem__)
    assert s.definitions["doc"].relations["owner"].allowed[0].type == "user"
    with pytest.raises(SchemaError, match="cycle"):
        parse("partial aaa { ...bbb }\npartial bbb { ...aaa }\ndefinition doc { ...aaa }")


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("definition doc { relation owner: user }", "no type"),
        ("definition user {}\ndefinition doc { relation owner: user | user }", "twice"),
        ("definition user {}\ndefinition doc { permission view = owner }", "no relation"),
        ("definition user {}\ndefinition doc { relation par: user:*\n permission view = par->view }", "wildcard"),
        ("definition user {}\ndefinition doc { permission aaa = bbb\n permission bbb = aaa }", "rests on itself"),
        ("definition user {}\ndefinition doc { relation owner: user with nope }", "no caveat"),
        ("caveat ccc(aaa int, bbb int) { aaa == 1 }", "unused"),
        ("definition user {}\ndefinition doc { relation owner: user with expiration }", "not in use"),
        ("definition user {}\ndefinition doc { relation owner: user\n permission view = owner->view }", "has 'view'"),
        ("definition doc { relation", "expected a name"),
    ],
)
def test_errors(text, message):
    with pytest.raises(SchemaError, match=message):
        load(text)


def test_set_laws():
    s = load(BASE % "aaa")
    for text, want in [("aaa + aaa", "aaa"), ("aaa + nil", "aaa"), ("aaa & nil", "nil"), ("aaa - aaa", "nil"), ("aaa & (aaa + bbb)", "aaa"), ("aaa + (aaa & bbb)", "aaa"), ("aaa - nil", "aaa"), ("aaa - (bbb + aaa)", "nil"), ("(aaa - bbb) & bbb", "nil")]:
        assert show(simplify(s, "doc", expr(text))) == want, text


def test_reflection():
    s = load("definition user {}\ndefinition team { relation member: user }\ndefinition doc { relation team: team\n relation owner: user\n permission view = owner + team->member }")
    assert dependents(s, ("doc", "view")) == [("doc", "owner"), ("doc", "team"), ("team", "member")]
    assert computable(s, ("team", "member")) == [("doc", "view")]
    assert ("arrow", "doc", "team->member", True) in entrypoints(s, ("doc", "view"), ("user", "..."))
    assert subject_types(s, ("doc", "view")) == {("user", "...")}
    assert any("points at a relation" in w for w in lint(s))
    assert diff(s, s) == []
