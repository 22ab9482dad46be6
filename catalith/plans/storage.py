"""Where jobs put intermediate results so that a lost executor loses nothing.

Every intermediate table lives in the folder that ``spark.checkpoint.dir`` names,
which the driver and all executors share, or in the session's checkpoint folder.  Where
neither is set, a local master (unit tests, a laptop) gets a private folder; on a cluster
that is an error, as executors would not see each other's files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: What has been written outside all scopes, and in the scope that the caller runs in.
_WRITTEN: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("catalith-scope", default=None)


def _mine() -> list[str]:
    held = _SCOPE.get()
    return _WRITTEN if held is None else held


@contextmanager
def scope() -> Iterator[None]:
    """What is written inside is counted and released apart from what others write meanwhile, in other threads too.

    What has not been released by its end is handed to the surroundings.
    """
    token = _SCOPE.set(held := [])
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _mine().extend(held)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if (chosen := sc.getCheckpointDir()) is not None:
        return chosen.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="catalith-")
    return _LOCAL[app]


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs far more than its rows' bytes suggest: small files come in few partitions."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage through the reliable checkpoint folder (eager).

    Meant for narrow frames (ids, labels, counts); use :func:`write_table` for wide ones.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    done = df.checkpoint(eager=True)
    file = done._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        _mine().append(file.get())
    return done


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/catalith-{name}-{uuid.uuid4().hex}"
    _mine().append(path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables and checkpoints this scope has written and not released."""
    return len(_mine())


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> int:
    """Delete what this scope has written since ``written()`` was ``since``, all or all but the last; call it once results are stored.

    Frames that still read such a table or checkpoint can't be run afterwards.
    """
    conf, n, mine = spark.sparkContext._jsc.hadoopConfiguration(), 0, _mine()
    last = mine[-1:] if keep_last and len(mine) > since else []
    gone, mine[since:] = mine[since : len(mine) - len(last)], last
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
