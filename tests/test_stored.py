"""Batches that appear as one: killed between tables, tried twice, pruned; documents stored and checked; logs dumped and loaded."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import stored, written
from palimpsest.sources import snapshots


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


def test_a_batch_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    read = lambda name: sorted((r.batch, r.k, r.v) for r in snapshots.published(spark, root, name, "k int, v string").collect())
    assert read("a") == [] and snapshots.latest(spark, root) is None
    broken = table(spark, (1, "x")).withColumn("k", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(root, "b1", {"a": table(spark, (1, "lost")), "b": broken})
    assert read("a") == [] and read("b") == []
    assert snapshots.publish(root, "b1", {"a": table(spark, (1, "x")), "b": table(spark, (2, "y"))})
    assert not snapshots.publish(root, "b1", {"a": table(spark, (9, "again")), "b": table(spark)})
    assert read("a") == [("b1", 1, "x")] and read("b") == [("b1", 2, "y")]
    assert snapshots.publish(root, "b2", {"a": table(spark, (3, "z"))}) and snapshots.publish(root, "b3", {"a": table(spark)})
    assert [r[1] for r in read("a")] == [1, 3] and snapshots.latest(spark, root) == "b3"
    plan = snapshots.published(spark, root, "a", "k int, v string")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dynamicpruning" in plan.lower()
    assert snapshots.keep_newest(spark, root, 2) == ["b1"] and read("a") == [("b2", 3, "z")] and read("b") == []
    with pytest.raises(ValueError, match="not a batch"):
        snapshots.publish(root, "../x", {"a": table(spark)})


def test_two_attempts_at_once(spark, tmp_path, monkeypatch):
    """One publishes while the other still writes: what the second wrote is never seen."""
    root, tables = str(tmp_path), {"a": table(spark, (1, "second"))}
    write = type(tables["a"].write).parquet
    done = []

    def slow(self, path, *args, **kw):
        if not done:
            done.append(1)
            assert snapshots.publish(root, "b", {"a": table(spark, (1, "first"))})
        return write(self, path, *args, **kw)

    monkeypatch.setattr(type(tables["a"].write), "parquet", slow)
    assert not snapshots.publish(root, "b", tables)
    assert [r.v for r in snapshots.published(spark, root, "a", "k int, v string").collect()] == ["first"]


def test_documents_are_stored_or_named(spark, tmp_path):
    docs = {1: '<section><h2 data-pages="1" data-box="1;0.1,0.1,0.2,0.2;0,1">A</h2><p data-pages="1,2" data-box="1;;0,3|2;;4,7">one two</p></section>', 2: '<p data-pages="9">no such page</p>', 3: '<p data-pages="1" data-box="1;0,0,2,1;0,1">b</p>', 4: '<ul><li data-pages="2">c</li></ul>'}
    pages = spark.createDataFrame([(c, p) for c in docs for p in (1, 2)], "content_id int, page int")
    wrong = stored.store(str(tmp_path), "first", spark.createDataFrame(list(docs.items()), "content_id int, html string"), pages)
    assert sorted((r.content_id, r.problem) for r in wrong.collect()) == [(2, "page"), (3, "coordinate")]
    read = lambda name, schema: snapshots.published(spark, str(tmp_path), name, schema).orderBy("content_id").collect()
    contents = read("contents", "content_id int, html string, text string")
    assert [(r.content_id, r.text) for r in contents] == [(1, "A\n\none two"), (4, "c")]
    assert contents[0].html == '<section data-nid="1" data-pages="1,2"><h2 data-nid="2" data-pages="1">A</h2><p data-nid="3" data-pages="1,2">one two</p></section>'
    nodes = read("nodes", f"content_id int, {stored.NODE}")
    for n in nodes:
        c = next(r for r in contents if r.content_id == n.content_id)
        assert c.html[n.html_start : n.html_end].startswith(f"<{n.tag}") and c.html[n.html_start : n.html_end].endswith(f"</{n.tag}>")
    regions = {(r.content_id, r.nid, r.page): (r.box and tuple(r.box), r.start, r.stop) for r in read("regions", f"content_id int, {stored.REGION}")}
    assert regions == {(1, 2, 1): ((0.1, 0.1, 0.2, 0.2), 0, 1), (1, 3, 1): (None, 3, 6), (1, 3, 2): (None, 7, 10), (4, 2, 2): (None, None, None)}
    assert len(read("pages", "content_id int, page int")) == 4 and written.BOX in stored.REGION


def test_a_dump_loads_as_it_was(spark, tmp_path):
    rows = [("a", 1, "x", False), ("a", 2, "y", True), ("b", 1, None, False), (None, 1, "n", False)]
    log = spark.createDataFrame(rows, "obj_id string, version int, name string, deleted boolean")
    assert stored.dump(str(tmp_path), "d1", log) and not stored.dump(str(tmp_path), "d1", log.limit(0))
    for left in (log.limit(0), log.where("obj_id = 'a'"), log):
        back = stored.load(str(tmp_path), "d1", left)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, log.collect()))
    assert stored.load(str(tmp_path), "none", log.limit(0)).count() == 0
