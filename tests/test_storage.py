from __future__ import annotations

import threading

import pytest

from catalith.plans import storage


def test_tables_survive_and_can_be_released(spark):
    df = storage.write_table(spark.range(5), "five")
    assert df.count() == 5 and storage.checkpoint(spark.range(3)).count() == 3
    assert storage.write_table(spark.range(0), "none").count() == 0
    assert storage.release(spark) >= 2 and storage.release(spark) == 0


def test_the_last_table_can_be_kept(spark):
    storage.release(spark)
    other = storage.write_table(spark.range(2), "other")
    before = storage.written()
    storage.write_table(spark.range(3), "a")
    last = storage.write_table(spark.range(4), "b")
    assert storage.release(spark, before, keep_last=True) == 1 and storage.release(spark, storage.written(), keep_last=True) == 0
    assert other.count() == 2 and last.count() == 4 and storage.release(spark) == 2


def test_scopes_release_their_own(spark):
    storage.release(spark)
    outside = storage.write_table(spark.range(1), "outside")
    made, barrier = {}, threading.Barrier(2)

    def job(name, n):
        with storage.scope():
            made[name, "first"] = storage.write_table(spark.range(n), name)
            storage.checkpoint(spark.range(n))
            barrier.wait()
            assert storage.written() == 2
            made[name, "last"] = storage.write_table(spark.range(n + 1), name)
            barrier.wait()
            assert storage.release(spark, 0, keep_last=True) == 2

    jobs = [threading.Thread(target=job, args=(f"job{n}", n)) for n in (2, 3)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert outside.count() == 1 and [made[f"job{n}", "last"].count() for n in (2, 3)] == [3, 4]
    with pytest.raises(Exception, match="job2"):
        made["job2", "first"].count()
    with storage.scope():
        storage.write_table(spark.range(1), "left")
    assert storage.written() == 4 and storage.release(spark) == 4  # with the last tables of both jobs


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
