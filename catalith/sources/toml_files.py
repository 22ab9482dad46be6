"""Folders of TOML files as a Spark data source, ``catalog_toml``, for reading and writing.

Reading: files are listed once and dealt, in the order of their paths, to partitions of
consecutive files; a row knows its file (``stem``) and the file's place in that order (``place``).  An
equality (or IN) on ``stem`` prunes files before partitions are planned, so one file is one
partition of one task.  ``kind`` names the schema: entity, stack, category (a row per table of the
array, in order) or text (the file as it is).  A missing folder is an error, or an empty relation
with ``missing = empty``.

Writing: rows (stem, content) become files; ``append`` replaces files of the same stem and leaves
others, ``overwrite`` also removes the rest.  A task stages its files, and a list of their stems, in a
folder of its own, so a failed, repeated or speculative task leaves nothing behind.  The job commits by
renaming one manifest, which names the tasks' folders, into place and then moves the files that they list;
until then readers see the old files, from then on the new ones, whether they have been moved yet or not,
and the next writer moves what a driver that died left.  An aborted job removes its staging folder and
touches nothing else.

A folder may hold millions of files.  Tasks send the driver no more than their folder's name; listings are
packed arrays of names and sizes (some 25 bytes a file), partitions are sent compressed (some 5 bytes a
file), and files are moved some thousand at a time.  Only a listing that needs sizes asks for each file;
looking for manifests reads names.  Staged files have their blocks before the commit, as a rename that replaces
a file would otherwise wait for each of them to be allocated.

Files are reached through ``pyarrow.fs`` (local and shared mounts, S3, GCS, HDFS) from all
executors; stores that only Spark reads are for ``toml.read_entities``.  Renames have to be atomic
for the commit to be.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from catalith.plans.schema import CATEGORY, ENTITY, STACK
from catalith.plans.storage import dealt
from catalith.sources.toml import _arrow, _shape, bind, bind_entity, bind_stack, loads

#: Files (option ``files``), and bytes, of a partition at the most (a larger file is a partition of its own).
FILES, BYTES = 1000, 8 * 2**20
#: Without that option a folder of more than ``FILES * SPANS`` files has more of them in a partition, as each costs a task's start.
SPANS = 200
#: Seconds after which the staging folder of a job that never ended is removed.
ABANDONED = 7 * 86_400
_MANIFEST, _STAGING = "_commit-", "_staging-"
#: In a task's staging folder the stems of its files 0, 1, ...; in the job's the stems that go.  A line of JSON each.
_STEMS = "_stems"
#: Files that are looked up or moved at once.
_SOME = 1000
#: A listing of files in place, and of staged ones: ``folder`` (-1 for a file in place) holds it as ``number``.
_IN_PLACE = pa.schema([("name", pa.large_binary()), ("size", pa.int32())])
_LISTED = pa.schema([*_IN_PLACE, ("folder", pa.int32()), ("number", pa.int32())])
_PLACED = [T.StructField("stem", T.StringType()), T.StructField("place", T.LongType())]
TEXT = T.StructType([T.StructField("content", T.StringType())])
KINDS: dict[str, T.StructType] = {"entity": ENTITY, "stack": STACK, "category": CATEGORY, "text": TEXT}


def records(kind: str, content: str, where: str) -> list[dict[str, Any]]:
    """The rows of a file."""
    if kind == "text":
        return [{"content": content}]
    doc = loads(content, where)
    if kind == "category":
        return [bind("category", c, where) | {"ord": i} for i, c in enumerate(doc.get("category", []))]
    return [bind_entity(doc, where) if kind == "entity" else bind_stack(doc, where)]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("/"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _mounted(store: fs.FileSystem) -> bool:
    return isinstance(store, fs.LocalFileSystem)


def _names(store: fs.FileSystem, base: str) -> Iterator[str]:
    """The names in a folder, without a look at each; of a mounted one never held as a whole."""
    if not _mounted(store):
        yield from (x.base_name for x in store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True)))
        return
    with contextlib.suppress(FileNotFoundError), os.scandir(base) as found:
        yield from (x.name for x in found)


def _sizes(store: fs.FileSystem, base: str, wanted: Callable[[str], bool]) -> Iterator[tuple[str, int]]:
    """Names and sizes of the wanted files directly in a folder; of a mounted one never held as a whole."""
    if not _mounted(store):
        found = store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True))
        yield from ((x.base_name, x.size) for x in found if x.type == fs.FileType.File and wanted(x.base_name))
        return
    with contextlib.suppress(FileNotFoundError), os.scandir(base) as found:
        for x in found:
            try:
                size = x.stat().st_size if wanted(x.name) and x.is_file() else None
            except FileNotFoundError:  # moved meanwhile
                continue
            if size is not None:
                yield x.name, size


def _text(store: fs.FileSystem, path: str) -> str:
    with open(path, "rb", buffering=0) if _mounted(store) else store.open_input_file(path) as f:
        return f.read().decode()


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    if not _mounted(store):
        with store.open_output_stream(path) as f:
            f.write(content)
        return
    with open(path, "wb") as f:
        if content:
            with contextlib.suppress(OSError, AttributeError):  # not every file system or platform can
                os.posix_fallocate(f.fileno(), 0, len(content))
        f.write(content)


def _move(store: fs.FileSystem, path: str, to: str) -> None:
    if _mounted(store):
        os.rename(path, to)
    else:
        store.move(path, to)


def _stems(store: fs.FileSystem, path: str) -> Iterator[str]:
    with store.open_input_stream(path) as raw, pa.PythonFile(raw, "r") as f:
        rest = b""
        while block := f.read(2**20):
            *lines, rest = (rest + block).split(b"\n")
            yield from json.loads(b"[" + b",".join(lines) + b"]")


def _pending(store: fs.FileSystem, manifests: Iterable[str]) -> list[dict[str, Any]]:
    """Manifests of committed jobs whose files have not all been moved."""
    return [json.loads(_text(store, path)) | {"path": path} for path in sorted(manifests)]


def _is_manifest(name: str) -> bool:
    return name.startswith(_MANIFEST) and name.endswith(".json")


def _manifests(store: fs.FileSystem, base: str) -> list[str]:
    return [f"{base}/{x}" for x in _names(store, base) if _is_manifest(x)]


def _staged_sizes(store: fs.FileSystem, folder: str, n: int) -> np.ndarray:
    """Sizes of a task's files by number, -1 where one has been moved."""
    sizes = np.full(n, -1, np.int64)
    for name, size in _sizes(store, folder, str.isdigit):
        sizes[int(name)] = size
    return sizes


def _packed(rows: Iterable[tuple[Any, ...]], schema: pa.Schema) -> pa.Table:
    tables = [schema.empty_table()]
    for some in batched(rows, 50_000):
        names, sizes, *where = zip(*some, strict=True)
        tables.append(pa.table([names, np.minimum(sizes, 2**31 - 1).astype(np.int32), *where], schema=schema))
    return pa.concat_tables(tables)


def _bytes(stems: Iterable[str]) -> pa.ChunkedArray:
    return pa.chunked_array([pa.array([f"{s}.toml".encode() for s in some], pa.large_binary()) for some in batched(stems, 50_000)], pa.large_binary())


class File(NamedTuple):
    """``path`` is None for a file that lies in its folder under its own name."""

    stem: str
    path: str | None
    size: int


@dataclass
class Listing:
    """Files in the order of their paths; ``found`` is unsorted, ``folders`` are those of staged ones, if there are any, and ``one`` is the path of a file that was named itself."""

    found: pa.Table
    order: pa.Array
    folders: list[str]
    one: str | None = None

    def files(self, places: np.ndarray | None = None) -> Iterator[File]:
        """All files, or those at some places."""
        order = self.order if places is None else self.order.take(pa.array(places))
        for s in range(0, len(order), 50_000):
            names, sizes, *where = (c.to_pylist() for c in self.found.take(order[s : s + 50_000]).columns)
            stems = (x[:-5].decode() for x in names)
            paths = (None if k < 0 else f"{self.folders[k]}/{i}" for k, i in zip(*where, strict=True)) if where else (self.one for _ in names)
            yield from map(File, stems, paths, sizes)

    def places(self, stems: set[str]) -> np.ndarray:
        there = pc.is_in(self.found["name"].combine_chunks(), pa.array([f"{x}.toml".encode() for x in stems if x is not None], pa.large_binary()))
        return np.flatnonzero(there.take(self.order).to_numpy(zero_copy_only=False))


def listed(path: str, missing: str = "error") -> Listing:
    """The ``*.toml`` files directly in a folder (or the one file), as committed."""
    store, base = _store(path)
    at = store.get_file_info(base)
    if at.type == fs.FileType.NotFound and missing != "empty":
        raise FileNotFoundError(path)
    if at.type == fs.FileType.File:
        name = f"{at.base_name.removesuffix('.toml')}.toml".encode()
        return Listing(_packed([(name, at.size)], _IN_PLACE), pa.array([0]), [], at.path)
    manifests: list[str] = []

    def wanted(name: str) -> bool:
        if name[0] not in "._":
            return name.endswith(".toml")
        if _is_manifest(name):
            manifests.append(f"{base}/{name}")
        return False

    found, folders = _packed(((name.encode(), size) for name, size in _sizes(store, base, wanted)), _IN_PLACE), []
    jobs = _pending(store, manifests)
    if jobs:
        found = pa.table([*found.columns, pa.array(np.full(len(found), -1, np.int32)), pa.array(np.zeros(len(found), np.int32))], schema=_LISTED)
    for job in jobs:
        start = len(folders)
        folders += [folder for folder, _ in job["folders"]]

        def staged(first: int, job: dict[str, Any] = job) -> Iterator[tuple[bytes, int, int, int]]:
            for k, (folder, n) in enumerate(job["folders"], first):
                sizes = _staged_sizes(store, folder, n)
                yield from ((f"{stem}.toml".encode(), int(sizes[i]), k, i) for i, stem in enumerate(_stems(store, f"{folder}/{_STEMS}")) if sizes[i] >= 0)

        new = _packed(staged(start), _LISTED)
        gone = pa.chunked_array([*new["name"].chunks, *_bytes(_stems(store, job["removed"]) if job["removed"] else ()).chunks], pa.large_binary())
        found = pa.concat_tables([found.filter(pc.invert(pc.is_in(found["name"], gone))), new])
    found = found.combine_chunks()
    return Listing(found, pc.sort_indices(found["name"]), folders)


def listing(path: str, missing: str = "error") -> Iterator[File]:
    """The files of :func:`listed` by path."""
    return listed(path, missing).files()


@contextlib.contextmanager
def _given_back() -> Iterator[None]:
    """Spark keeps the processes that plan and commit, one of each kind beside the driver, so what a listing took is given back."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()


def _drop(store: fs.FileSystem, folder: str) -> None:
    for _ in range(5):  # a task that is being stopped may add a file meanwhile
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return
        with contextlib.suppress(OSError):
            store.delete_dir(folder)
            return
        time.sleep(0.2)


def sweep(store: fs.FileSystem, base: str, age: float = ABANDONED) -> None:
    """Remove staging folders of jobs that ended without a word so many seconds ago."""
    names = [x for x in _names(store, base) if x.startswith(_STAGING) or _is_manifest(x)]
    wanted = {job["staging"] for job in _pending(store, (f"{base}/{x}" for x in names if _is_manifest(x)))}
    for x in store.get_file_info([f"{base}/{x}" for x in names if x.startswith(_STAGING)]):
        if x.path not in wanted and x.mtime_ns is not None and time.time() - x.mtime_ns / 1e9 > age:
            _drop(store, x.path)


def _all_of(store: fs.FileSystem, work: Callable[[Any], None], items: Iterable[Any]) -> None:
    """``work`` on every item, some at a time on a few threads; on a mount one after the other, as the kernel lets one rename in at a time and others spin."""

    def each(some: Iterable[Any]) -> None:
        for x in some:
            work(x)

    if _mounted(store):
        each(items)
        return
    with ThreadPoolExecutor(16) as pool:
        for many in batched(batched(items, _SOME // 16), 64):
            list(pool.map(each, many))


def roll_forward(store: fs.FileSystem, base: str) -> None:
    """Move the files of committed jobs into place; doing it again changes nothing."""

    def remove(stem: str) -> None:
        if store.get_file_info(f"{base}/{stem}.toml").type == fs.FileType.File:
            store.delete_file(f"{base}/{stem}.toml")

    for job in _pending(store, _manifests(store, base)):
        for folder, n in job["folders"]:
            here = np.zeros(n, bool)
            here[[int(x) for x in _names(store, folder) if x.isdigit()]] = True
            staged = ((f"{folder}/{i}", f"{base}/{stem}.toml") for i, stem in enumerate(_stems(store, f"{folder}/{_STEMS}")) if here[i])
            _all_of(store, lambda x: _move(store, *x), staged)
        if job["removed"]:
            _all_of(store, remove, _stems(store, job["removed"]))
        store.delete_file(job["path"])
        _drop(store, job["staging"])


@dataclass
class Span(InputPartition):
    """Consecutive files (place, stem, path), packed."""

    packed: bytes

    @classmethod
    def of(cls, files: list[tuple[int, str, str | None]]) -> Span:
        return cls(zlib.compress(json.dumps(files).encode()))

    def files(self) -> list[tuple[int, str, str | None]]:
        return json.loads(zlib.decompress(self.packed))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str, schema: T.StructType):
        self.path, self.missing, self.kind, self.fields = options["path"], options.get("missing", "error"), kind, schema
        self.files = int(options["files"]) if "files" in options else None
        self.only: set[str] | None = {options["stem"]} if "stem" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("stem",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with _given_back():
            return self._spans()

    def _spans(self) -> list[InputPartition]:
        there = listed(self.path, self.missing)
        places = None if self.only is None else there.places(self.only)
        most = self.files or max(FILES, len(there.order) // SPANS)
        spans, files, size = [], [], 0
        for place, f in zip(range(len(there.order)) if places is None else places.tolist(), there.files(places), strict=True):
            if files and (len(files) == most or size + f.size > BYTES):
                spans.append(Span.of(files))
                files, size = [], 0
            files.append((place, f.stem, f.path))
            size += f.size
        return [*spans, Span.of(files)] if files or not spans else spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.path)
        arrow = pa.schema(list(_arrow(self.fields)))
        for some in batched(span.files(), 100):
            at = ((place, stem, path or f"{base}/{stem}.toml") for place, stem, path in some)
            rows = [{"stem": stem, "place": place} | r for place, stem, path in at for r in records(self.kind, _text(store, path), path)]
            yield pa.RecordBatch.from_pylist([_shape(r, self.fields) for r in rows], schema=arrow)


def _repeated(names: pa.ChunkedArray) -> list[str]:
    """Some of the stems that are there more than once."""
    names = names.combine_chunks()
    order, twice = pc.sort_indices(names), []
    for s in range(0, len(order) - 1, 50_000):
        near = names.take(order[s : s + 50_001])
        twice += {x.as_py().decode().removesuffix(".toml") for x in near[1:].filter(pc.equal(near[1:], near[:-1]))}
        if len(twice) >= 5:
            break
    return sorted(twice)[:5]


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and how many files it staged there."""

    folder: str
    n: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        if not {"stem", "content"} <= set(schema.names):
            raise ValueError("columns stem and content are needed")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        store, base = _store(path)
        store.create_dir(self._staging(base), recursive=True)

    def _staging(self, base: str) -> str:
        return f"{base}/{_STAGING}{self.job}"

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        store, base = _store(self.path)
        folder = f"{self._staging(base)}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=False)  # an aborted job's folder is gone, and its tasks that still run fail
        n = 0
        with store.open_output_stream(f"{folder}/{_STEMS}", buffer_size=2**16) as stems:
            for r in rows:
                if not r["stem"] or r["stem"][0] in "._" or "/" in r["stem"] or r["content"] is None:
                    raise ValueError(f"{r['stem']!r} can't be a file")
                content = r["content"] if isinstance(r["content"], bytes | bytearray) else r["content"].encode()
                _put(store, f"{folder}/{n}", bytes(content))
                stems.write(f"{json.dumps(r['stem'])}\n".encode())
                n += 1
        return Staged(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with _given_back():
            self._commit(messages)

    def _commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        roll_forward(store, base)  # what a job before left
        folders = [(m.folder, m.n) for m in messages if m is not None and m.n]
        new = _bytes(stem for folder, _ in folders for stem in _stems(store, f"{folder}/{_STEMS}"))
        if twice := _repeated(new):
            raise ValueError(f"more than one row for {twice}")
        removed = f"{self._staging(base)}/{_STEMS}" if self.overwrite else None
        if removed:
            with store.open_output_stream(removed, buffer_size=2**16) as f:
                old = _bytes(x.stem for x in listing(self.path))
                for some in old.filter(pc.invert(pc.is_in(old, new))).chunks:
                    f.write("".join(f"{json.dumps(x.decode().removesuffix('.toml'))}\n" for x in some.to_pylist()).encode())
            del old
        del new
        pa.default_memory_pool().release_unused()  # moving takes long, and nothing of these
        manifest = f"{base}/{_MANIFEST}{self.job}.json"
        with store.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps({"folders": folders, "removed": removed, "staging": self._staging(base)}).encode())
        store.move(f"{manifest}.new", manifest)  # from here on the job is done
        roll_forward(store, base)
        sweep(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{_MANIFEST}{self.job}.json").type == fs.FileType.File:
            return  # committed: the next writer moves the rest
        _drop(store, self._staging(base))


class ArrowWriter(Writer, DataSourceArrowWriter):
    """The same from Arrow batches, which Spark hands over without making rows."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        parts = (b.slice(i, _SOME) for b in batches for i in range(0, len(b), _SOME))
        return super().write(r for some in parts for r in some.select(["stem", "content"]).to_pylist())


class CatalogToml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_toml"

    def _kind(self) -> str:
        kind = self.options.get("kind", "entity")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind}")
        return kind

    def schema(self) -> T.StructType:
        return T.StructType([*_PLACED, *KINDS[self._kind()].fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options), self._kind(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogToml)
    return spark


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether Spark reads a path from a file system that all machines mount, as the data source would."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getUri().getScheme() == "file"


def read(spark: SparkSession, path: str, kind: str = "entity", missing: str = "error", files: int | None = None) -> DataFrame:
    """The rows of a folder with ``stem`` and ``place``; filter on ``stem`` to read single files."""
    found = register(spark).read.format("catalog_toml").option("kind", kind).option("missing", missing)
    return (found if files is None else found.option("files", files)).load(path)


def write(files: DataFrame, path: str, mode: str = "append", deal: bool = True) -> None:
    """Rows (stem, content) as files of a folder; unless ``deal`` is false, written by all cores however few partitions the rows come in."""
    register(files.sparkSession)
    rows = files.select("stem", "content")
    (dealt(rows) if deal else rows).write.format("catalog_toml").mode(mode).save(path)
