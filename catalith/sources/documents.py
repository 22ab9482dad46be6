"""Whole documents as files, written and read by many tasks: the data source ``catalog_document``.

A document is the lines of sorted rows.  Each task writes the rows of its range as a part; the job commits one
manifest that lists the parts in order with their bytes, lines and SHA-256, so parts put together are the
document and nothing ever holds it whole.  Without a manifest there is no document: a job that
fails leaves none, and one that writes again replaces the old by renaming its manifest over it.

Reading: a part is a partition; a row knows its line's number in the whole document (``line_no``, from 0), as the
manifest says where each part begins.  ``cat`` gives the parts' paths in order, for tools that want one file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from catalith.sources.toml_files import _store

MANIFEST = "manifest.json"
#: Lines handed to Spark at a time.
LINES = 10_000


def manifest(path: str) -> list[dict]:
    """The parts of a document in order: name, bytes, lines, sha256."""
    store, base = _store(path)
    with store.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


def cat(path: str) -> list[str]:
    """The paths of a document's parts in order."""
    _, base = _store(path)
    return [f"{base}/{p['name']}" for p in manifest(path)]


@dataclass
class Part(WriterCommitMessage):
    place: int
    entry: dict


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        store, base = _store(self.path)
        place = TaskContext.get().partitionId()
        name = f"part-{place:05d}-{self.job}-{uuid.uuid4().hex[:8]}"
        store.create_dir(base, recursive=True)
        digest, size, lines = hashlib.sha256(), 0, 0
        with store.open_output_stream(f"{base}/{name}") as f:
            for r in rows:
                text = (r["text"] or "").encode()
                if text and not text.endswith(b"\n"):
                    text += b"\n"
                f.write(text)
                digest.update(text)
                size, lines = size + len(text), lines + text.count(b"\n")
        return Part(place, {"name": name, "bytes": size, "lines": lines, "sha256": digest.hexdigest()})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        at = f"{base}/{MANIFEST}.{self.job}"
        with store.open_output_stream(at) as f:
            f.write(json.dumps({"parts": [m.entry for m in done if m.entry["bytes"]]}).encode())
        store.move(at, f"{base}/{MANIFEST}")
        self._drop(store, base, {m.entry["name"] for m in done if m.entry["bytes"]})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            self._drop(store, base, {p["name"] for p in manifest(self.path)})

    @staticmethod
    def _drop(store: fs.FileSystem, base: str, kept: set[str]) -> None:
        """Remove parts that no manifest lists: of the document before, and of tasks that failed or ran twice."""
        for x in store.get_file_info(fs.FileSelector(base)):
            if x.base_name.startswith("part-") and x.base_name not in kept:
                store.delete_file(x.path)


@dataclass
class Lines(InputPartition):
    name: str
    first: int


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for p in manifest(self.path):
            out.append(Lines(p["name"], first))
            first += p["lines"]
        return out or [Lines("", 0)]

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, base = _store(self.path)
        at, held = part.first, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"line_no": pa.array(range(at, at + len(held)), pa.int64()), "line": pa.array([x.decode() for x in held], pa.string())})

        with store.open_input_stream(f"{base}/{part.name}", buffer_size=2**20) as f:
            rest = b""
            while chunk := f.read(2**20):
                *whole, rest = (rest + chunk).split(b"\n")
                held += whole
                if len(held) >= LINES:
                    yield batch()
                    at, held = at + len(held), []
        if held:
            yield batch()


class CatalogDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_document"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"])


def write(rows: DataFrame, text: str, order: list[Column], path: str) -> None:
    """The texts of ``rows`` in the given order as a document; a text that doesn't end a line gets its line feed."""
    rows.sparkSession.dataSource.register(CatalogDocument)
    rows.orderBy(*order).select(F.col(text).alias("text")).write.format("catalog_document").mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a document."""
    spark.dataSource.register(CatalogDocument)
    return spark.read.format("catalog_document").load(path)
