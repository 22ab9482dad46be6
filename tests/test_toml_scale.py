"""What a folder of millions of files costs: no look at each file, no wait at each move, no task for each thousand."""

from __future__ import annotations

import os
from unittest import mock

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter

from catalith.plans import file_queries
from catalith.sources import toml_files

SCHEMA = T.StructType().add("stem", "string").add("content", "string")


def staged(at, rows, overwrite=False):
    writer = toml_files.Writer(str(at), SCHEMA, overwrite)
    return writer, [writer.write({"stem": s, "content": c} for s, c in rows)]


def test_commits_look_at_no_file_that_is_there(tmp_path):
    for i in range(50):
        (tmp_path / f"e{i}.toml").write_text("x = 1")
    writer, done = staged(tmp_path, [("e7", "x = 2")])
    looked, store_of = [], toml_files._store

    class Spy:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def get_file_info(self, what):
            looked.extend(what if isinstance(what, list) else [])
            return self.store.get_file_info(what)

    local = lambda store: isinstance(getattr(store, "store", store), toml_files.fs.LocalFileSystem)
    with mock.patch.object(toml_files, "_store", lambda path: (Spy(store_of(path)[0]), store_of(path)[1])), mock.patch.object(toml_files, "_mounted", local):
        writer.commit(done)
    assert not [x for x in looked if str(x).endswith(".toml")]
    assert (tmp_path / "e7.toml").read_text() == "x = 2" and len(os.listdir(tmp_path)) == 50


def test_staged_files_have_their_blocks_and_moves_of_a_mount_need_no_threads(tmp_path):
    (tmp_path / "a.toml").write_text("old")
    with mock.patch.object(os, "posix_fallocate", side_effect=OSError) as given:  # nor does it matter where that can't be done
        writer, done = staged(tmp_path, [("a", "x = 'ä'"), ("b", "")])
    assert [c.args[1:] for c in given.call_args_list] == [(0, 8)]
    with mock.patch.object(toml_files, "ThreadPoolExecutor", side_effect=AssertionError):
        writer.commit(done)
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"a.toml": "x = 'ä'", "b.toml": ""}


def test_partitions_of_a_large_folder(tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"e{i:02}.toml").write_text("x = 1" * (i + 1))
    monkeypatch.setattr(toml_files, "FILES", 2)
    monkeypatch.setattr(toml_files, "SPANS", 3)
    spans = lambda **o: [[(p, s) for p, s, _ in x.files()] for x in toml_files.Reader({"path": str(tmp_path), **o}, "text", toml_files.TEXT).partitions()]
    assert [len(s) for s in spans()] == [10, 10, 10] and sum(spans(), []) == [(i, f"e{i:02}") for i in range(30)]
    assert len(spans(files="2")) == 15 and spans(stem="e07") == [[(7, "e07")]] and spans(stem="none") == [[]]
    monkeypatch.setattr(toml_files, "BYTES", 400)
    assert max(sum(5 * (p + 1) for p, _ in s) for s in spans()) <= 400 and len(spans()) > 3


def test_one_file_is_read_by_its_own_path(spark, tmp_path):
    (tmp_path / "one.toml").write_text("x = 1")
    assert [tuple(f) for f in toml_files.listing(str(tmp_path / "one.toml"))] == [("one", str(tmp_path / "one.toml"), 5)]
    assert [r.content for r in toml_files.read(spark, str(tmp_path / "one.toml"), "text").collect()] == ["x = 1"]


def test_spark_hands_over_arrow(spark, tmp_path):
    writer = toml_files.CatalogToml({"path": str(tmp_path)}).writer(SCHEMA, True)
    assert isinstance(writer, DataSourceArrowWriter)
    writer.abort([])
    binary = spark.createDataFrame([("z", "a", bytearray(b"\xff"))], "other string, stem string, content binary")
    toml_files.write(binary, str(tmp_path / "d"))
    assert (tmp_path / "d" / "a.toml").read_bytes() == b"\xff"


def test_texts_are_made_on_all_cores_and_dealt_once(spark):
    seen = []
    with mock.patch.object(toml_files, "write", lambda files, path, mode="append", deal=True: seen.append((files.rdd.getNumPartitions(), deal))):
        file_queries._entity_files(spark, "/root/testdata/sf0.001", "unused")
    assert seen[0][0] >= spark.sparkContext.defaultParallelism and not seen[0][1]
