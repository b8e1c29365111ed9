import itertools
import random

import pytest
from naive import Naive
from pyspark.sql import functions as F

from permspark.operators.engine import Engine
from permspark.plans.compiler import DepthError
from permspark.plans.schema import load
from permspark.sources.text import from_texts

STATES = {"NO": 0, "CONDITIONAL": 1, "HAS": 2}
#: name: schema, edges, (object, permission, subject, answer) and perhaps a context
CASES = {
    "either relation will do": ("definition chef {}\ndefinition recipe { relation author: chef\n relation taster: chef\n permission publish = author\n permission cook = author + taster }",
        ["recipe:soup#author@chef:ines", "recipe:soup#taster@chef:bela", "recipe:bread#taster@chef:ines"],
        [("recipe:soup", "publish", "chef:ines", "HAS"), ("recipe:soup", "publish", "chef:bela", "NO"), ("recipe:soup", "cook", "chef:bela", "HAS"), ("recipe:bread", "cook", "chef:ines", "HAS"), ("recipe:bread", "publish", "chef:ines", "NO"), ("recipe:cake", "cook", "chef:ines", "NO")], {}),
    "crews within fleets": ("definition sailor {}\ndefinition crew { relation aboard: sailor | crew#aboard }\ndefinition harbour { relation berth: crew#aboard | sailor }",
        ["crew:watch#aboard@sailor:odd", "crew:deck#aboard@crew:watch#aboard", "crew:deck#aboard@sailor:eli", "harbour:north#berth@crew:deck#aboard", "harbour:south#berth@sailor:eli"],
        [("harbour:north", "berth", "sailor:odd", "HAS"), ("harbour:north", "berth", "sailor:eli", "HAS"), ("harbour:south", "berth", "sailor:odd", "NO"), ("harbour:north", "berth", "crew:watch#aboard", "HAS"), ("harbour:south", "berth", "crew:deck#aboard", "NO")], {}),
    "cycle": ("definition user {}\ndefinition group { relation member: user | group#member }",
        ["group:aaa#member@group:bbb#member", "group:bbb#member@group:aaa#member", "group:bbb#member@user:tom"],
        [("group:aaa", "member", "user:tom", "HAS"), ("group:aaa", "member", "group:aaa#member", "HAS"), ("group:bbb", "member", "user:fred", "NO")], {}),
    "ticket holders but those barred, unless pardoned": ("definition fan {}\ndefinition stadium { relation ticket: fan\n relation barred: fan\n relation pardon: fan\n permission kept_out = barred - pardon\n permission enter = ticket - kept_out }\ndefinition match { relation venue: stadium\n permission attend = venue->enter }",
        ["stadium:oval#ticket@fan:uma", "stadium:oval#ticket@fan:rex", "stadium:oval#ticket@fan:zoe", "stadium:oval#barred@fan:rex", "stadium:oval#barred@fan:zoe", "stadium:oval#barred@fan:lou", "stadium:oval#pardon@fan:zoe", "match:final#venue@stadium:oval"],
        [("match:final", "attend", "fan:uma", "HAS"), ("match:final", "attend", "fan:rex", "NO"), ("match:final", "attend", "fan:zoe", "HAS"), ("match:final", "attend", "fan:lou", "NO"), ("stadium:oval", "kept_out", "fan:lou", "HAS")], {}),
    "signed off by each laboratory": ("definition chemist {}\ndefinition laboratory { relation staff: chemist }\ndefinition batch { relation tested_in: laboratory\n permission knows_all = tested_in.all(staff)\n permission knows_some = tested_in.any(staff)\n permission torn = knows_some - knows_all }",
        ["laboratory:acid#staff@chemist:ida", "laboratory:base#staff@chemist:ida", "laboratory:base#staff@chemist:kai", "batch:b7#tested_in@laboratory:acid", "batch:b7#tested_in@laboratory:base", "batch:b8#tested_in@laboratory:base", "batch:b9#tested_in@laboratory:empty", "batch:b9#tested_in@laboratory:base"],
        [("batch:b7", "knows_all", "chemist:ida", "HAS"), ("batch:b7", "knows_all", "chemist:kai", "NO"), ("batch:b7", "torn", "chemist:kai", "HAS"), ("batch:b8", "knows_all", "chemist:kai", "HAS"), ("batch:b9", "knows_all", "chemist:kai", "NO"), ("batch:b9", "knows_some", "chemist:kai", "HAS"), ("batch:b0", "knows_all", "chemist:ida", "NO")], {}),
    "a park open to all but some of the banned": ("definition walker {}\ndefinition park { relation open_to: walker:* | walker\n relation fined: walker\n relation paid: walker\n permission owing = fined - paid\n permission stroll = open_to - owing }",
        ["park:green#open_to@walker:*", "park:green#fined@walker:moe", "park:green#fined@walker:sol", "park:green#paid@walker:sol", "park:walled#open_to@walker:moe", "park:walled#fined@walker:moe"],
        [("park:green", "stroll", "walker:sol", "HAS"), ("park:green", "stroll", "walker:moe", "NO"), ("park:green", "stroll", "walker:passerby", "HAS"), ("park:walled", "stroll", "walker:moe", "NO"), ("park:walled", "stroll", "walker:passerby", "NO")], {}),
    "a strike that may shut everybody out": ("caveat on_strike(day int, since int) { day >= since }\ndefinition rider {}\ndefinition line { relation pass: rider\n relation shut_out: rider:* with on_strike | rider\n permission ride = pass - shut_out }",
        ["line:blue#pass@rider:ana", "line:blue#pass@rider:ben", 'line:blue#shut_out@rider:*[on_strike:{"since":5}]', "line:blue#shut_out@rider:ben", "line:red#pass@rider:ana"],
        [("line:blue", "ride", "rider:ana", "CONDITIONAL"), ("line:blue", "ride", "rider:ben", "NO"), ("line:red", "ride", "rider:ana", "HAS")], {}),
    "the day before the strike": ("caveat on_strike(day int, since int) { day >= since }\ndefinition rider {}\ndefinition line { relation pass: rider\n relation shut_out: rider:* with on_strike | rider\n permission ride = pass - shut_out }",
        ["line:blue#pass@rider:ana", 'line:blue#shut_out@rider:*[on_strike:{"since":5}]'], [("line:blue", "ride", "rider:ana", "HAS")], {"day": 4}),
    "stored context decides, or the lack of it": ("caveat tall(cm double) { cm > 140.0 }\ndefinition child {}\ndefinition coaster { relation rider: child | child with tall\n permission board = rider }",
        ['coaster:loop#rider@child:ava[tall:{"cm":150.5}]', 'coaster:loop#rider@child:bo[tall:{"cm":120}]', "coaster:loop#rider@child:cy[tall]", "coaster:loop#rider@child:di"],
        [("coaster:loop", "board", "child:ava", "HAS"), ("coaster:loop", "board", "child:bo", "NO"), ("coaster:loop", "board", "child:cy", "CONDITIONAL"), ("coaster:loop", "board", "child:di", "HAS")], {}),
    "each key of a vault, some of them worn": ("caveat fits(turns int) { turns < 3 }\ndefinition keeper {}\ndefinition lock { relation key: keeper with fits | keeper }\ndefinition vault { relation lock: lock | lock with fits\n permission unseal = lock.all(key) }",
        ['lock:top#key@keeper:jo[fits:{"turns":1}]', "lock:low#key@keeper:jo", 'lock:old#key@keeper:jo[fits:{"turns":9}]', "lock:odd#key@keeper:jo[fits]",
         "vault:gold#lock@lock:top", "vault:gold#lock@lock:low", "vault:tin#lock@lock:top", "vault:tin#lock@lock:old", "vault:clay#lock@lock:low", "vault:clay#lock@lock:odd", "vault:wax#lock@lock:low", 'vault:wax#lock@lock:top[fits:{"turns":7}]'],
        [("vault:gold", "unseal", "keeper:jo", "HAS"), ("vault:tin", "unseal", "keeper:jo", "NO"), ("vault:clay", "unseal", "keeper:jo", "CONDITIONAL"), ("vault:wax", "unseal", "keeper:jo", "NO"), ("vault:gold", "unseal", "keeper:no", "NO")], {}),
    "self": ("use self\ndefinition monk { relation abbot: monk\n permission confide = self + abbot }", ["monk:hugo#abbot@monk:anselm"], [("monk:hugo", "confide", "monk:hugo", "HAS"), ("monk:hugo", "confide", "monk:anselm", "HAS"), ("monk:anselm", "confide", "monk:hugo", "NO")], {}),
    "recursion through &": ("definition user {}\ndefinition folder { relation parent: folder\n relation viewer: user\n relation allowed: user\n permission view = (viewer + parent->view) & allowed }",
        ["folder:f1#viewer@user:tom", "folder:f1#allowed@user:tom", "folder:f2#parent@folder:f1", "folder:f2#allowed@user:tom", "folder:f3#parent@folder:f2"],
        [("folder:f1", "view", "user:tom", "HAS"), ("folder:f2", "view", "user:tom", "HAS"), ("folder:f3", "view", "user:tom", "NO")], {}),
    "open on both sides of every operator": ("definition guest {}\ndefinition hall { relation day: guest:* | guest\n relation night: guest:* | guest\n permission whole = day & night\n permission either = day + night\n permission day_only = day - night }",
        ["hall:east#day@guest:*", "hall:east#night@guest:*", "hall:west#day@guest:*", "hall:west#night@guest:pip", "hall:moon#night@guest:*", "hall:moon#day@guest:pip"],
        [("hall:east", "whole", "guest:pip", "HAS"), ("hall:east", "day_only", "guest:pip", "NO"), ("hall:west", "whole", "guest:pip", "HAS"), ("hall:west", "whole", "guest:ray", "NO"), ("hall:west", "day_only", "guest:ray", "HAS"), ("hall:west", "day_only", "guest:pip", "NO"), ("hall:moon", "day_only", "guest:pip", "NO"), ("hall:moon", "either", "guest:ray", "HAS")], {}),
    "arrow past a type without the target": ("definition miner {}\ndefinition shaft { relation foreman: miner\n permission descend = foreman }\ndefinition office { relation clerk: miner }\ndefinition lamp { relation kept_in: shaft | office\n permission take = kept_in->descend\n permission take_all = kept_in.all(descend) }",
        ["shaft:deep#foreman@miner:gus", "office:main#clerk@miner:gus", "lamp:l1#kept_in@shaft:deep", "lamp:l2#kept_in@office:main", "lamp:l3#kept_in@shaft:deep", "lamp:l3#kept_in@office:main"],
        [("lamp:l1", "take", "miner:gus", "HAS"), ("lamp:l2", "take", "miner:gus", "NO"), ("lamp:l3", "take", "miner:gus", "HAS"), ("lamp:l1", "take_all", "miner:gus", "HAS"), ("lamp:l3", "take_all", "miner:gus", "NO")], {}),
    "the way and the goal both have conditions": ("caveat dry(rain int) { rain < 2 }\ncaveat awake(hour int) { hour > 6 }\ndefinition hiker {}\ndefinition hut { relation guest: hiker with awake\n permission sleep = guest }\ndefinition trail { relation leads_to: hut with dry\n permission reach = leads_to->sleep }",
        ['hut:high#guest@hiker:lea[awake:{"hour":9}]', 'hut:high#guest@hiker:tim[awake:{"hour":2}]', "hut:high#guest@hiker:una[awake]", "trail:ridge#leads_to@hut:high[dry]"],
        [("trail:ridge", "reach", "hiker:lea", "CONDITIONAL"), ("trail:ridge", "reach", "hiker:tim", "NO"), ("trail:ridge", "reach", "hiker:una", "CONDITIONAL")], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    schema, lines, checks, context = CASES[name]
    e = Engine(schema, from_texts(spark, lines), context)
    assert e.check_bulk([c[:3] for c in checks]) == [c[3] for c in checks]
    n = Naive(load(schema), lines, context)
    for obj, perm, subject, want in checks:
        st, _, rest = subject.partition(":")
        sid, _, rel = rest.partition("#")
        assert n.table((st, sid, rel or "...")).get((*obj.split(":"), perm), 0) == STATES[want]


def test_expiration(spark):
    schema = "use expiration\ndefinition skater {}\ndefinition rink { relation ticket: skater with expiration | skater\n permission skate = ticket }"
    edges = from_texts(spark, ["rink:ice#ticket@skater:old[expiration:2001-05-06T07:08:09Z]", "rink:ice#ticket@skater:new[expiration:2101-05-06T07:08:09Z]", "rink:ice#ticket@skater:ever", "rink:ice#ticket@skater:now[expiration:2050-01-01T00:00:00Z]"])
    e = Engine(schema, edges, as_of="2050-01-01 00:00:00")
    assert e.check_bulk([("rink:ice", "skate", f"skater:{s}") for s in ("old", "new", "ever", "now")]) == ["NO", "HAS", "HAS", "NO"]


def test_lookups_errors_and_missing(spark):
    schema, lines, _, _ = CASES["a strike that may shut everybody out"]
    e = Engine(schema, from_texts(spark, lines))
    pairs = spark.createDataFrame([("blue", "ana")], "resource_id string, subject_id string")
    assert e.check(pairs, "line", "ride", "rider").first().missing == ["day"]
    assert e.check_bulk([("line:blue", "ride", "rider:*"), ("line:blue", "nope", "rider:ben"), ("line:blue", "ride", "rider:ben")])[2] == "NO"
    assert e.check_bulk([("line:blue", "ride", "rider:*")])[0].startswith("ERROR")
    schema, lines, _, _ = CASES["a park open to all but some of the banned"]
    e = Engine(schema, from_texts(spark, lines))
    rows = e.lookup_subjects(spark.createDataFrame([("green",)], "resource_id string"), "park", "stroll", "walker").collect()
    star = next(r for r in rows if r.subject_id == "*")
    assert [(x.subject_id, x.permissionship) for x in star.excluded] == [("moe", "NO")]
    found = e.lookup_resources(spark.createDataFrame([("moe",), ("any",)], "subject_id string"), "park", "stroll", "walker").collect()
    assert [(r.subject_id, r.resource_id) for r in found] == [("any", "green")]
    assert [r.permissionship for r in e.permissions("park", "stroll", "walker", resource_id="green", subject_id="moe").collect()] == ["NO"]
    assert e.expand("park:green", "stroll")["operation"] == "exclusion"
    e.register_views("t_")
    assert spark.sql("SELECT count(*) FROM t_relationships").first()[0] == len(lines)


def test_depth(spark):
    schema = CASES["cycle"][0]
    lines = [f"group:g{i:03}#member@group:g{i + 1:03}#member" for i in range(6)] + ["group:g006#member@user:tom"]
    with pytest.raises(DepthError):
        Engine(schema, from_texts(spark, lines), max_depth=3).members("group", "member", "user").collect()


RANDOM = """
caveat ccc(xxx int) { xxx > 1 }
definition user {}
definition group { relation member: user | user with ccc | group#member }
definition folder { relation parent: folder\n relation viewer: user | group#member | user with ccc\n permission view = viewer + parent->view }
definition doc {
  relation folder: folder | folder with ccc
  relation owner: user | user:* | user with ccc
  relation banned: user | user:* with ccc | group#member
  permission aaa = owner - banned
  permission bbb = owner & (banned + folder->view)
  permission ccc = folder.all(view) + (owner - (banned - owner))
  permission ddd = (aaa + folder.any(view)) - bbb
  permission eee = folder.all(view) - banned
}
"""


GRAPHS = 24


def random_lines(seed):
    """Edges of one random graph; its ids begin with its number, so graphs don't meet."""
    rng = random.Random(seed)
    ids = lambda kind, n: [f"{seed}_{kind}{i}" for i in range(n)]
    users, groups, folders, docs = ids("u", 3), ids("g", 3), ids("f", 3), ids("d", 4)
    caveat = lambda: rng.choice(["", "", '[ccc:{"xxx":2}]', '[ccc:{"xxx":0}]', "[ccc]"])
    pick, keyed = rng.choice, {}
    for _ in range(34):
        line = pick([
            f"group:{pick(groups)}#member@user:{pick(users)}{caveat()}", f"group:{pick(groups)}#member@group:{pick(groups)}#member", f"folder:{pick(folders)}#parent@folder:{pick(folders)}",
            f"folder:{pick(folders)}#viewer@user:{pick(users)}{caveat()}", f"folder:{pick(folders)}#viewer@group:{pick(groups)}#member", f"doc:{pick(docs)}#folder@folder:{pick(folders)}{caveat()}",
            f"doc:{pick(docs)}#owner@user:{pick([*users, '*'])}", f"doc:{pick(docs)}#owner@user:{pick(users)}{caveat()}", f"doc:{pick(docs)}#banned@user:{pick(users)}", f"doc:{pick(docs)}#banned@user:*[ccc]",
            f"doc:{pick(docs)}#banned@group:{pick(groups)}#member",
        ])
        keyed.setdefault(line.split("[")[0], line)  # an edge has one caveat
    return users, docs, sorted(keyed.values())


def test_random_graphs_agree_with_the_naive_evaluator(spark):
    graphs = [random_lines(seed) for seed in range(GRAPHS)]
    e = Engine(RANDOM, from_texts(spark, [x for g in graphs for x in g[2]]))
    tables, asked = {}, []
    for users, docs, lines in graphs:
        n, some = Naive(load(RANDOM), lines), [*users, f"{users[0]}_stranger"]
        asked += itertools.product(docs, some)
        tables |= {u: n.table(("user", u, "...")) for u in some}
    pairs = spark.createDataFrame(asked, "resource_id string, subject_id string").coalesce(4).cache()
    for p in ("aaa", "bbb", "ccc", "ddd", "eee"):
        got = {(r.resource_id, r.subject_id): r.permissionship for r in e.check(pairs, "doc", p, "user").collect()}
        want = {(d, u): next(k for k, v in STATES.items() if v == tables[u].get(("doc", d, p), 0)) for d, u in asked}
        assert got == want, p
        # lookups agree with checks; public objects of other graphs are found, too
        rows = e.lookup_resources(pairs.select("subject_id").distinct(), "doc", p, "user").collect()
        assert {(r.resource_id, r.subject_id): r.permissionship for r in rows if (r.resource_id, r.subject_id) in want} == {k: v for k, v in got.items() if v != "NO"}


def test_plans_push_filters_to_the_scan(spark, tmp_path):
    from permspark.operators.reads import Filter, read
    from permspark.sources.tables import read_edges, write_edges

    write_edges(from_texts(spark, ["document:one#reader@user:tom", "folder:one#viewer@user:tom"]), str(tmp_path / "edges"))
    df = read(read_edges(spark, str(tmp_path / "edges")), Filter(type="document", relation="reader", ids=("one",)))
    assert df.count() == 1
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(resource_type" in plan
    assert df.select(F.col("subject_id")).first()[0] == "tom"
