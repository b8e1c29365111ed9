import pytest

from permspark.operators.reads import CursorError, Filter, SubjectSelector, collect_garbage, decode_token, encode_token, page, pick_revision
from permspark.operators.writes import Store, WriteError
from permspark.plans.schema import load
from permspark.sources.tables import sign, validation_file, verify
from permspark.sources.text import TextError, from_texts, parse_edge, read_text, write_text

SCHEMA = """use expiration
caveat some(cond int) { cond == 42 }
definition user {}
definition doc { relation viewer: user | user with some | user with expiration
  relation owner: user:*
  permission view = viewer }"""


def updates(spark, op, *lines):
    from pyspark.sql import functions as F

    return from_texts(spark, list(lines)).withColumn("operation", F.lit(op))


def test_store(spark):
    s = Store(spark, load(SCHEMA))
    assert s.write(updates(spark, "CREATE", "doc:one#viewer@user:tom", "doc:two#viewer@user:tom")) == 1
    with pytest.raises(WriteError, match="exists"):
        s.write(updates(spark, "CREATE", "doc:one#viewer@user:tom"))
    s.write(updates(spark, "TOUCH", 'doc:one#viewer@user:tom[some:{"cond":42}]', "doc:two#viewer@user:tom"))
    assert s.at().where("caveat_name = 'some'").count() == 1
    assert s.history.count() == 3  # the touch of an equal edge changes nothing
    assert s.at(1).where("caveat_name IS NULL").count() == 2
    events = [(r.revision, r.operation) for r in s.changes(1).collect()]
    assert events == [(2, "TOUCH")]  # within one revision a touch beats the delete
    s.write(updates(spark, "DELETE", "doc:two#viewer@user:tom", "doc:none#viewer@user:tom"))
    assert s.at().count() == 1
    assert collect_garbage(s.history, 2).count() == 2
    with pytest.raises(WriteError, match="twice"):
        s.write(updates(spark, "TOUCH", "doc:one#viewer@user:tom", 'doc:one#viewer@user:tom[some:{"cond":1}]'))
    with pytest.raises(WriteError, match="precondition"):
        s.write(updates(spark, "TOUCH", "doc:one#viewer@user:ann"), [("must_not_match", Filter(type="doc"))])
    for bad, reason in (("doc:one#view@user:tom", "permission"), ("doc:one#viewer@user:*", "not allowed"), ("doc:one#owner@user:tom", "not allowed"), ('doc:one#viewer@user:x[some:{"nope":1}]', "no parameter"), ('doc:one#viewer@user:x[some:{"cond":"a"}]', "not a value")):
        with pytest.raises(WriteError, match=reason):
            s.write(updates(spark, "TOUCH", bad))
    s.register_counter("docs", Filter(type="doc"))
    assert s.count("docs") == 1
    s.bulk_load(from_texts(spark, [f"doc:d{i}#viewer@user:ann" for i in range(5)]))
    with pytest.raises(WriteError, match="more than"):
        s.delete(Filter(prefix="d"), limit=2)
    assert s.delete(Filter(prefix="d"), limit=2, allow_partial=True) == "PARTIAL"
    assert s.count("docs") == 4
    assert s.delete(Filter(prefix="d")) == "COMPLETE"
    with pytest.raises(WriteError, match="edges"):
        s.replace_schema(load("definition user {}\ndefinition doc { relation owner: user }"))


def test_filters_and_pages(spark):
    df = from_texts(spark, [f"doc:d{i}#viewer@user:u{i % 3}" for i in range(10)] + ["doc:d1#viewer@group:g1#member"])
    with pytest.raises(ValueError):
        Filter()
    with pytest.raises(ValueError):
        Filter(ids=("a",), prefix="b")
    assert df.where(Filter(subjects=(SubjectSelector(relations=("non-ellipsis",)),)).column()).count() == 1
    assert df.where(Filter(subjects=(SubjectSelector("user", ("u1",)), SubjectSelector("group"))).column()).count() == 4
    for size in (1, 3, 11, 100):
        rows, cursor = page(df, Filter(type="doc"), size)
        while cursor:
            more, cursor = page(df, Filter(type="doc"), size, cursor)
            rows += more
        assert len(rows) == 11 and [r.resource_id for r in rows] == sorted(r.resource_id for r in rows)
    with pytest.raises(CursorError):
        page(df, Filter(type="other"), 3, page(df, Filter(type="doc"), 3)[1])


def test_revisions():
    assert pick_revision(17, "minimize_latency", 5) == 15
    assert pick_revision(17, "fully_consistent", 5) == 17
    assert pick_revision(17, ">=" + encode_token(16), 5) == 16
    assert pick_revision(17, "@" + encode_token(3)) == 3
    with pytest.raises(ValueError):
        pick_revision(17, "@" + encode_token(18))
    with pytest.raises(ValueError):
        decode_token(encode_token(1, "other"))


def test_text(spark, tmp_path):
    lines = ['doc:a/b|c=+-_#viewer@user:tom[some:{"cond":42}][expiration:2030-01-02T03:04:05Z]', "org/doc:one#viewer@user:*", "doc:one#viewer@group:ggg#member"]
    df = from_texts(spark, lines)
    write_text(df, str(tmp_path / "out"), 2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)
    assert sorted(map(str, read_text(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    assert parse_edge(lines[1])[4] == "*"
    for bad in ("doc:one#viewer", "Doc:one#viewer@user:tom", "doc:*#viewer@user:tom"):
        with pytest.raises(TextError):
            parse_edge(bad)


def test_integrity(spark):
    df = sign(from_texts(spark, ["doc:one#viewer@user:tom", "doc:two#viewer@user:tom"]), "k1", b"secret")
    assert verify(df, {"k1": b"secret"}).count() == 0
    from pyspark.sql import functions as F

    forged = df.withColumn("subject_id", F.when(F.col("resource_id") == "one", "ann").otherwise(F.col("subject_id")))
    assert verify(forged, {"k1": b"secret"}).count() == 1
    assert verify(df, {"k2": b"secret"}).count() == 2


def test_validation_file():
    v = validation_file('schema: "definition user {}"\nrelationships: |\n  doc:one#viewer@user:tom\n  // no\nassertions:\n  assertTrue:\n    - \'doc:one#view@user:tom with {"a": 1}\'\n')
    assert v.relationships == ["doc:one#viewer@user:tom"] and v.true == [("doc:one#view@user:tom", {"a": 1})]


def events(spark, rows):
    """Events from (revision, operation, edge); an empty edge for SCHEMA and CHECKPOINT."""
    from pyspark.sql import functions as F

    from permspark.streaming.watch import EVENT

    names = [x.split()[0] for x in EVENT.split(", ")]
    out = None
    for revision, operation, line in rows:
        e = from_texts(spark, [line or "none:none#none@none:none"]).withColumns({"revision": F.lit(revision).cast("long"), "operation": F.lit(operation)}).select(*names)
        out = e if out is None else out.unionByName(e)
    return out.coalesce(1)


def test_watch_delivers_whole_revisions(spark, tmp_path):
    import time

    from permspark.streaming.watch import RevisionError, only, resume, stream, watch

    doc, other, folder = "doc:one#viewer@user:tom", "doc:two#viewer@user:tom", "folder:one#viewer@user:tom"
    batches = [
        [(3, "DELETE", doc), (2, "TOUCH", folder), (3, "DELETE", folder)],
        [(3, "TOUCH", doc), (3, "DELETE", other)],  # the rest of revision 3
        [(4, "SCHEMA", None), (5, "TOUCH", other)],
        [(5, "CHECKPOINT", None)],
    ]
    for k, b in enumerate(batches):
        events(spark, b).write.parquet(str(tmp_path / "in" / f"b{k}"))
        time.sleep(1.1)  # files are taken by their time
    got = []
    keep = lambda df, top: got.append(([(r.revision, r.operation, r.resource_id) for r in df.collect()], top))
    run = lambda extra=None, **o: watch(stream(spark, str(tmp_path / "in" / "*"), after=resume(encode_token(2)), maxFilesPerTrigger=1), keep, str(tmp_path / "cp"), **o).awaitTermination(120)
    run(schema=True)
    assert [x for x in got if x[0]] == [([(3, "TOUCH", "one"), (3, "DELETE", "two"), (3, "DELETE", "one"), (4, "SCHEMA", "none")], 4), ([(5, "TOUCH", "two")], 5)]
    events(spark, [(5, "DELETE", other)]).write.parquet(str(tmp_path / "in" / "late"))
    with pytest.raises(Exception, match="came after"):
        run(schema=True)
    with pytest.raises(RevisionError):
        resume(encode_token(2), oldest=3)
    assert only(events(spark, batches[0]), types=["doc"]).count() == 1
    with pytest.raises(ValueError):
        only(events(spark, batches[0]), types=["doc"], filters=[Filter(type="doc")])


def test_store_is_durable_and_optimistic(spark, tmp_path):
    import os

    from permspark.operators.writes import ConflictError
    from permspark.plans.materialize import release

    path = str(tmp_path / "store")
    s = Store(spark, load(SCHEMA), path)
    s.write(updates(spark, "CREATE", "doc:one#viewer@user:tom", "doc:two#viewer@user:tom"))
    s.register_counter("docs", Filter(type="doc", subjects=(SubjectSelector("user", ("tom",)),)))
    release(spark)
    again, rival = Store(spark, path=path), Store(spark, path=path)
    assert again.revision == 2 and again.count("docs") == 2 and again.schema.definitions.keys() == s.schema.definitions.keys()
    assert again.write(updates(spark, "DELETE", "doc:one#viewer@user:tom")) == 3
    with pytest.raises(ConflictError):
        rival.write(updates(spark, "TOUCH", "doc:one#viewer@user:ann"))
    assert rival.refresh() == 3 and rival.write(updates(spark, "TOUCH", "doc:one#viewer@user:tom", 'doc:two#viewer@user:tom[some:{"cond":1}]')) == 4
    assert again.refresh() == 4
    folders = len(again.folders)
    versions = lambda x: sorted((r.resource_id, r.created_rev, r.deleted_rev) for r in x.history.collect())
    want = [("one", 1, 3), ("one", 4, None), ("two", 1, 4), ("two", 4, None)]
    assert versions(again) == want
    assert [again.at(r).count() for r in (0, 1, 2, 3, 4)] == [0, 2, 2, 1, 2]
    again.compact()
    assert folders == 3 and len(again.folders) == 1 and versions(again) == want
    again.compact(horizon=4)
    assert versions(Store(spark, path=path)) == [("one", 4, None), ("two", 4, None)]
    for old in (lambda: again.at(3), lambda: again.at(99), lambda: again.changes(2)):
        with pytest.raises(WriteError):
            old()
    with pytest.raises(WriteError, match="no store"):
        Store(spark, path=str(tmp_path / "nothing"))
    assert len(os.listdir(path + "/commits")) >= 6


def test_cut_and_release(spark):
    import os

    from permspark.plans.materialize import _written, cut, release

    assert cut(spark.range(3).toDF("x")).count() == 3
    path = _written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    release(spark)
    assert not os.path.exists(path) and not _written
