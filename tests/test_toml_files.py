"""The TOML data source, its commit protocol and the lossless replacement of a table."""

from __future__ import annotations

import os
import pickle
import tomllib

import pytest
from pyspark.sql import functions as F

from catalith.plans.catalog import Catalog
from catalith.sources import toml_files
from catalith.sources.toml_text import put_table, scan

TEXTS = [
    'id = "a"\nd = """\n[metrics]\nx\n"""\n\n# keep\n[metrics] # m\nstars = 1 # c\nold = [\n[1],\n[2]]\n\n[metrics.crate]\nname = "x"\n# in\n\n# next\n[other]\ny = 1\n',
    "a = 1\n[ metrics ]\nstars=2\n[[metrics.x]]\nq = 1\n[[metrics.x]]\nq = 2\n# end",
    "metrics.stars = 3\nb = 2\n",
    'metrics = { stars = 3, s = "}" }\n"b" = 2',
    "",
    "[metrics]",
    "x = 1\r\n[metrics]\r\nstars = 1\r\n",
    "[\"metrics\"]\n  stars = 1\n  't' = 2\n[z]",
    "[[metrics]]\nx = 1\n[[metrics]]\n[metrics.y]\n",
    "k = '''\n[metrics]'''''\nl = \"\"\"a\\\"\"\"\"\"\n[metrics]\nv = 1979-05-27 07:32:00 # d\n",
    "[a]\nx = [ # [metrics]\n  '#', \"]\", # }\n  { y = [1] },\n]\n[metrics.crate]\nname = 'q'\n[b]\n",
]
BODIES = ['stars = 9\nname = "n"\n', 'stars = 9\n[metrics.crate]\nname = "c"\nowners = ["x", "y"]\n', '[metrics.crate]\nname = "c"\n', ""]


@pytest.mark.parametrize("text", TEXTS)
def test_only_the_table_changes(text):
    assert "".join(text[p.start : p.end] for p in scan(text)) == text
    before = tomllib.loads(text)
    before.pop("metrics", None)
    for body in BODIES:
        out = put_table(text, "metrics", body)
        after = tomllib.loads(out)
        assert after.pop("metrics") == tomllib.loads(body.replace("[metrics.crate]", "[crate]")) and after == before
        assert put_table(out, "metrics", body) == out


def test_comments_and_places():
    out = put_table(TEXTS[0], "metrics", "stars = 2\nfresh = true\n")
    assert out == TEXTS[0].split("[metrics] #")[0] + "[metrics] # m\nstars = 2 # c\nfresh = true\n# in\n\n# next\n[other]\ny = 1\n"
    assert put_table(TEXTS[6], "metrics", "a = 1\n") == "x = 1\r\n[metrics]\r\na = 1\r\n"
    assert put_table("x = 1 # y", ("m", "a b"), "z = 1\n") == 'x = 1 # y\n[m."a b"]\nz = 1\n'
    for bad in ('a = "x', "a = [1", "[a", "a", "= 1", 'a = "1" b = 2', "a = ", "a = 'x\n'"):
        with pytest.raises(ValueError, match="line"):
            put_table(bad, "metrics", "")
    with pytest.raises(ValueError, match="not part of"):
        put_table("", "metrics", "[other]\nx = 1\n")


def files(spark, rows, parts=3):
    return spark.createDataFrame(rows, "stem string, content string").repartition(parts)


def tree(path):
    return {f: (path / f).read_text() for f in sorted(os.listdir(path)) if f.endswith(".toml")}


ENTITY = 'id = "{0}"\nname = "N{0}"\nrepository = "r"\ncategory = "c"\n'


def test_read_in_order_and_prune(spark, tmp_path):
    toml_files.write(files(spark, [(f"e{i}", ENTITY.format(f"e{i}")) for i in range(35)]), str(tmp_path))
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "_hidden.toml").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.toml").write_text("no")
    df = toml_files.read(spark, f"file://{tmp_path}", files=10)
    assert df.rdd.getNumPartitions() == 4
    got = df.select("stem", "place", "name").collect()  # in order without a sort
    assert [r.stem for r in got] == sorted(f"e{i}" for i in range(35)) and [r.place for r in got] == list(range(35))
    one = df.where("stem = 'e7' AND name = 'Ne7'")
    assert one.rdd.getNumPartitions() == 1 and [(r.id, r.place) for r in one.collect()] == [("e7", 32)]
    assert df.where(F.col("stem").isin("e7", "e8", "zz")).count() == 2 and df.where("stem = 'zz'").count() == 0
    assert toml_files.register(spark).read.format("catalog_toml").option("stem", "e3").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="nothing-here"):
        toml_files.read(spark, f"{tmp_path}/nothing-here").count()
    assert toml_files.read(spark, f"{tmp_path}/nothing-here", "stack", missing="empty").count() == 0
    (tmp_path / "bad.toml").write_text("id = ")
    with pytest.raises(Exception, match="bad.toml"):
        toml_files.read(spark, str(tmp_path)).count()


def test_append_overwrite_and_abort(spark, tmp_path):
    at = str(tmp_path / "d")
    toml_files.write(files(spark, [("a", "x = 1"), ("b", "x = 2")]), at)
    toml_files.write(files(spark, [("b", "x = 3"), ("c", "x = 4")]), at)
    before = {"a.toml": "x = 1", "b.toml": "x = 3", "c.toml": "x = 4"}
    assert tree(tmp_path / "d") == before and sorted(os.listdir(at)) == sorted(before)
    for bad in [("d", None), ("", "x"), ("../e", "x"), ("_f", "x")]:  # a task fails after others have staged their files
        with pytest.raises(Exception, match="can't be a file"):
            toml_files.write(files(spark, [("a", "lost"), ("b", "lost"), bad]), at)
        assert tree(tmp_path / "d") == before and sorted(os.listdir(at)) == sorted(before)
    with pytest.raises(Exception, match="more than one row"):
        toml_files.write(files(spark, [("a", "1"), ("a", "2")]), at)
    assert tree(tmp_path / "d") == before and sorted(os.listdir(at)) == sorted(before)
    toml_files.write(files(spark, [("b", "x = 5")]), at, "overwrite")
    assert tree(tmp_path / "d") == {"b.toml": "x = 5"}
    toml_files.write(files(spark, []), at)
    assert tree(tmp_path / "d") == {"b.toml": "x = 5"}
    (tmp_path / "d" / "_staging-lost").mkdir()
    toml_files.sweep(*toml_files._store(at))
    assert "_staging-lost" in os.listdir(at)
    toml_files.sweep(*toml_files._store(at), age=-1)
    assert os.listdir(at) == ["b.toml"]


def test_committed_job_of_a_driver_that_died(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "d")
    toml_files.write(files(spark, [("a", "v = 1"), ("b", "v = 1"), ("c", "v = 1")]), at)
    schema = files(spark, []).schema
    writer = toml_files.Writer(at, schema, overwrite=True)
    done = [writer.write(iter([{"stem": s, "content": "v = 2"}])) for s in ("a", "b")]
    moved = toml_files.roll_forward
    monkeypatch.setattr(toml_files, "roll_forward", lambda store, base: None)
    writer.commit(done)  # the manifest is in place, no file has moved
    writer.abort(done)  # too late to change anything
    assert tree(tmp_path / "d")["c.toml"] == "v = 1"
    seen = {r.stem: r.content for r in toml_files.read(spark, at, "text").collect()}
    assert seen == {"a": "v = 2", "b": "v = 2"}
    monkeypatch.setattr(toml_files, "roll_forward", moved)
    store, base = toml_files._store(at)
    toml_files.roll_forward(store, base)
    toml_files.roll_forward(store, base)
    assert tree(tmp_path / "d") == {"a.toml": "v = 2", "b.toml": "v = 2"} and len(os.listdir(at)) == 2


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    n, at = 2000, str(tmp_path / "entities")
    writer = toml_files.Writer(at, files(spark, []).schema, overwrite=True)
    done = [writer.write({"stem": f"e{i}", "content": ENTITY.format(f"e{i}")} for i in range(k, n, 2)) for k in (0, 1)]
    assert sum(len(pickle.dumps(m)) for m in done) < 1000
    writer.commit(done)
    spans = toml_files.Reader({"path": at}, "entity", toml_files.KINDS["entity"]).partitions()
    assert len(spans) == 2 and sum(len(pickle.dumps(s)) for s in spans) < 8 * n
    assert [stem for s in spans for _, stem, _ in s.files()] == sorted(f"e{i}" for i in range(n))


def tasks_of(spark, group, run):
    """The most tasks of a stage of what ``run`` does."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    return max(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)


def test_writing_uses_all_cores(spark, tmp_path):
    one = files(spark, [(f"e{i}", "x = 1") for i in range(50)], 1)
    assert tasks_of(spark, "write", lambda: toml_files.write(one, str(tmp_path / "d"))) == 4
    assert len(tree(tmp_path / "d")) == 50


def test_overwrite_removes_what_is_not_written(spark, tmp_path):
    at = str(tmp_path / "d")
    toml_files.write(files(spark, [(f"old {i}\n\"", "x = 1") for i in range(30)] + [("both", "x = 1")]), at)
    toml_files.write(files(spark, [("both", "x = 2"), ("a-b", "y = 1"), ("a", "y = 2")]), at, "overwrite")
    assert tree(tmp_path / "d") == {"a-b.toml": "y = 1", "a.toml": "y = 2", "both.toml": "x = 2"}
    assert [r.stem for r in toml_files.read(spark, at, "text").collect()] == ["a-b", "a", "both"]


def test_a_catalog_is_loaded_from_packed_listings(spark, tmp_path):
    toml_files.write(files(spark, [(f"e{i}", ENTITY.format(f"e{i}")) for i in range(20)]), str(tmp_path / "entities"))
    (tmp_path / "categories.toml").write_text('[[category]]\nid = "c"\nname = "C"\n')
    loaded = Catalog.load(spark, str(tmp_path)).entities
    assert loaded.count() == 20 and "catalog_toml" in loaded._jdf.queryExecution().logical().toString()
    loaded.unpersist()
