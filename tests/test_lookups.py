import pytest

from permspark.operators.engine import Engine
from permspark.operators.reads import CursorError
from permspark.plans import compiler
from permspark.sources.text import from_texts

GROUPS = "definition user {}\ndefinition group { relation member: user | group#member }\ndefinition folder { relation parent: folder\n relation viewer: user | group#member\n permission view = viewer + parent->view }"


def test_recursion_starts_from_the_objects_asked_for(spark, monkeypatch):
    lines = [f"group:p{i}#member@group:q{i}#member" for i in range(60)] + [f"group:q{i}#member@user:u{i}" for i in range(60)] + ["group:q7#member@group:p7#member", "folder:top#viewer@group:p7#member", "folder:sub#parent@folder:top", "folder:other#viewer@group:p9#member"]
    written, real = [], compiler.cut

    def cut(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(compiler, "cut", cut)
    e = Engine(GROUPS, from_texts(spark, lines))
    ask = lambda x: spark.createDataFrame([(x,)], "resource_id string")
    assert {(r.resource_id, r.subject_id) for r in e.lookup_subjects(ask("p7"), "group", "member", "user").collect()} == {("p7", "u7")}
    assert max(written[1:]) <= 6, written  # only the edges themselves are more
    assert [r.subject_id for r in e.lookup_subjects(ask("sub"), "folder", "view", "user").collect()] == ["u7"]
    assert e.check_bulk([("folder:sub", "view", "user:u7"), ("folder:sub", "view", "user:u9"), ("folder:other", "view", "user:u9"), ("group:q7", "member", "group:p7#member")]) == ["HAS", "NO", "HAS", "HAS"]


def test_lookup_pages(spark):
    lines = [f"folder:f{i:02}#viewer@user:u{i % 2}" for i in range(11)]
    e = Engine(GROUPS, from_texts(spark, lines))
    who = spark.createDataFrame([("u0",), ("u1",)], "subject_id string")
    whole = [(r.resource_id, r.subject_id) for r in e.lookup_resources(who, "folder", "view", "user").orderBy("resource_id", "subject_id").collect()]
    for size in (4, 11):
        rows, cursor = e.lookup_resources_page(who, "folder", "view", "user", limit=size)
        while cursor:
            more, cursor = e.lookup_resources_page(who, "folder", "view", "user", limit=size, cursor=cursor)
            rows += more
        assert [(r.resource_id, r.subject_id) for r in rows] == whole and len(whole) == 11
    _, cursor = e.lookup_resources_page(who, "folder", "view", "user", limit=2)
    for bad in (cursor, "!!", "e30="):
        with pytest.raises(CursorError):
            e.lookup_resources_page(who, "folder", "viewer", "user", limit=2, cursor=bad)
    with pytest.raises(ValueError):
        e.lookup_resources_page(who, "folder", "view", "user", limit=0)


def test_a_bad_context_is_the_error_of_its_own_items(spark):
    schema = "caveat third(marks list<int>) { marks[2] > 1 }\ndefinition pupil {}\ndefinition course { relation entrant: pupil with third | pupil\n relation pass: pupil\n permission sit = entrant + pass }"
    lines = ['course:c#entrant@pupil:ok[third:{"marks":[1,2,3]}]', 'course:c#entrant@pupil:short[third:{"marks":[1]}]', 'course:c#entrant@pupil:lucky[third:{"marks":[1]}]', "course:c#pass@pupil:lucky", "course:c#entrant@pupil:plain"]
    e = Engine(schema, from_texts(spark, lines))
    got = e.check_bulk([("course:c", "sit", f"pupil:{p}") for p in ("ok", "short", "lucky", "plain", "none")])
    assert got[:1] + got[2:] == ["HAS", "HAS", "HAS", "NO"] and got[1].startswith("ERROR: third: ")
    pairs = spark.createDataFrame([("short",)], "subject_id string")
    assert [r.permissionship for r in e.lookup_resources(pairs, "course", "sit", "pupil").collect()] == ["ERROR"]


def test_expand_with_usersets_conditions_and_cycles(spark):
    schema = "caveat odd(n int) { n % 2 == 1 }\ndefinition user {}\ndefinition band { relation player: user | user with odd | band#player }\ndefinition gig { relation act: band\n relation guest: user | band#player\n permission stage = guest + act->player }"
    lines = ["band:a#player@user:x", "band:a#player@band:b#player", "band:b#player@user:y[odd]", "band:b#player@band:a#player", "gig:g#guest@band:a#player", "gig:g#act@band:b"]
    e = Engine(schema, from_texts(spark, lines))
    flat = e.expand("gig:g", "stage")
    assert flat["operation"] == "union" and flat["children"][0] == {"leaf": "gig:g#guest", "subjects": ["band:a#player"]}
    assert flat["children"][1]["children"][0]["subjects"]["conditions"] == {"user:y": ["n"]}
    deep = e.expand("gig:g", "stage", deep=True)["children"][0]["children"][0]
    assert deep["subjects"] == ["band:b#player", "user:x"] and deep["children"][0]["subjects"] == ["band:a#player", "user:y"] and "children" not in deep["children"][0]
    with pytest.raises(ValueError):
        e.expand("gig:g", "nope")


def test_public_objects_as_one_row(spark):
    schema = "definition user {}\ndefinition film { relation seer: user | user:*\n relation banned: user\n permission see = seer - banned }"
    e = Engine(schema, from_texts(spark, ["film:f#seer@user:*", "film:f#banned@user:b", "film:g#seer@user:a"]))
    who = spark.createDataFrame([("a",), ("b",), ("c",)], "subject_id string")
    rows = lambda **o: {(r.subject_id, r.resource_id, r.permissionship) for r in e.lookup_resources(who, "film", "see", "user", **o).collect()}
    assert rows() == {("a", "f", "HAS"), ("c", "f", "HAS"), ("a", "g", "HAS")}
    assert rows(public="star") == {("*", "f", "HAS"), ("b", "f", "NO"), ("a", "g", "HAS")}
    with pytest.raises(ValueError):
        rows(public="all")


def test_validation_files_are_run(spark):
    from permspark.sources.tables import failures, validation_file

    schema = "caveat old(age int) { age > 17 }\ndefinition user {}\ndefinition bar { relation guest: user | user:* | user with old\n relation out: user\n permission enter = guest - out }"
    text = f"schemaFile: models.txt\nrelationships: |\n  bar:one#guest@user:*\n  bar:one#out@user:bo\n  bar:two#guest@user:al[old]\nassertions:\n  assertTrue:\n    - bar:one#enter@user:al\n    - 'bar:two#enter@user:al with {{\"age\": 20}}'\n  assertCaveated:\n    - bar:two#enter@user:al\n  assertFalse:\n    - bar:one#enter@user:bo\n    - bar:two#enter@user:bo\nvalidation:\n  bar:one#enter:\n    - '[user:* - {{user:bo}}] is <bar:one#guest>'\n  bar:two#enter:\n    - '[user:al[...]] is <bar:two#guest>'\n"
    v = validation_file(text, lambda name: schema if name == "models.txt" else None)
    assert failures(spark, v) == []
    v.true.append(("bar:one#enter@user:bo", {}))
    v.expected["bar:two#enter"] = [("user:al", False, ())]
    assert len(failures(spark, v)) == 3
    with pytest.raises(ValueError):
        validation_file("relationships: ''")


def test_filters_that_the_schema_rules_out():
    from permspark.operators.reads import Filter, SubjectSelector, check_filter
    from permspark.plans.schema import load

    s = load("caveat c(n int) { n > 1 }\ndefinition user {}\ndefinition team { relation member: user }\ndefinition doc { relation viewer: user | team#member | user with c\n relation open: user:* }")
    for f in (Filter(type="doc", relation="viewer"), Filter(relation="open", subjects=(SubjectSelector("user", ("*",)),)), Filter(subjects=(SubjectSelector("team", relations=("member",)),)), Filter(type="doc", caveat="c"), Filter(caveat="none"), Filter(subjects=(SubjectSelector(relations=("non-ellipsis",)),))):
        check_filter(s, f)
    for f in (
        Filter(type="dock"), Filter(type="doc", relation="member"), Filter(type="doc", relation="open", subjects=(SubjectSelector("team"),)), Filter(type="doc", relation="viewer", subjects=(SubjectSelector("user", ("*",)),)),
        Filter(subjects=(SubjectSelector("team", relations=("owner",)),)), Filter(caveat="d"), Filter(type="team", caveat="c"), Filter(type="team", subjects=(SubjectSelector(relations=("non-ellipsis",)),)), Filter(subjects=(SubjectSelector("crew"),)),
    ):
        with pytest.raises(ValueError):
            check_filter(s, f)
