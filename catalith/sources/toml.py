"""TOML tables as DataFrames.

Files are listed and read by Spark's own ``binaryFile`` reader, so any file system works and
each file is one row; parsing and binding run in Arrow batches on the executors.  Files
are small records of a curated catalog, one entity each, so a row holds a whole file.
"""

from __future__ import annotations

import datetime as dt
import tomllib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.plans.schema import CATEGORY, DEFAULTS, ENTITY, REQUIRED, STACK
from catalith.sources.toml_text import put_table

_MAX_COUNT = {"stars": 2**32 - 1, "forks": 2**32 - 1, "open_issues": 2**32 - 1}


def _date(v: Any) -> dt.date | None:
    return dt.date.fromisoformat(v) if isinstance(v, str) else v


def _stamp(v: Any) -> dt.datetime | None:
    """An RFC 3339 stamp; digits past microseconds are cut."""
    if not isinstance(v, str):
        return v
    head, dot, rest = v.replace("Z", "+00:00").partition(".")
    if dot:
        digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
        v = f"{head}.{digits[:6].ljust(6, '0')}{rest[len(digits):]}"
    return dt.datetime.fromisoformat(v.replace("Z", "+00:00"))


def loads(content: str, where: str) -> dict[str, Any]:
    """A parsed file; an error names it."""
    try:
        return tomllib.loads(content)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{where}: {e}") from e


def bind(kind: str, record: dict[str, Any], where: str) -> dict[str, Any]:
    """Defaults for absent keys; an absent required key is an error that names the file."""
    for key in REQUIRED.get(kind, []):
        if record.get(key) is None:
            raise ValueError(f"{where}: {kind} has no {key}")
    return DEFAULTS.get(kind, {}) | record


def bind_entity(record: dict[str, Any], where: str) -> dict[str, Any]:
    entity = bind("entity", record, where)
    entity["added"] = _date(entity.get("added"))
    if (m := entity.get("metrics")) is not None:
        m = bind("metrics", m, where)
        for key, most in _MAX_COUNT.items():
            if m.get(key) is not None and not 0 <= m[key] <= most:
                raise ValueError(f"{where}: {key} is out of range")
        m["last_commit"] = _date(m.get("last_commit"))
        m["updated_at_raw"] = None if m.get("updated_at") is None else str(m["updated_at"])
        m["updated_at"] = _stamp(m.get("updated_at"))
        if (c := m.get("crate")) is not None:
            c = bind("crate", c, where)
            c["latest_release"] = _date(c.get("latest_release"))
            m["crate"] = c
        entity["metrics"] = m
    return entity


def bind_stack(record: dict[str, Any], where: str) -> dict[str, Any]:
    record = dict(record)
    if "pick" in record:
        record["picks"] = record.pop("pick")
    stack = bind("stack", record, where)
    stack["picks"] = [bind("pick", p, where) for p in stack["picks"]]
    return stack


def _shape(value: Any, kind: T.DataType) -> Any:
    """The fields of a struct type, in order; unknown keys are left out."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shape(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_shape(v, kind.elementType) for v in value]
    return value


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.DateType(): pa.date32(), T.TimestampType(): pa.timestamp("us", tz="UTC")}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", _arrow(kind.elementType), kind.containsNull))
    return _ARROW[kind]


def _parsed(files: DataFrame, schema: T.StructType, rows: Callable[[dict[str, Any], str], list[dict[str, Any]]]) -> DataFrame:
    arrow = pa.schema(list(_arrow(schema)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_shape(r, schema) for path, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in rows(loads(body.decode(), path), path)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("path", "content").mapInArrow(parse, schema)


def _files(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """The ``*.toml`` files directly in a folder, or one of them by stem."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"{only or '*'}.toml").option("recursiveFileLookup", "false").load(path)


def parse_entities(files: DataFrame) -> DataFrame:
    """One row per file of a frame (path, content)."""
    return _parsed(files, ENTITY, lambda doc, where: [bind_entity(doc, where)])


def read_entities(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """One row per file of a folder; ``only`` reads a single file by its stem."""
    return parse_entities(_files(spark, path, only))


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_entities` for stacks; a missing folder is an empty relation."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], STACK)
    return _parsed(_files(spark, path), STACK, lambda doc, where: [bind_stack(doc, where)])


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """The ``[[category]]`` tables of one file; ``ord`` keeps their order, which has meaning."""
    files = spark.read.format("binaryFile").load(path)
    return _parsed(files, CATEGORY, lambda doc, where: [bind("category", c, where) | {"ord": i} for i, c in enumerate(doc.get("category", []))])


def write_metrics(entities: DataFrame, path: str) -> None:
    """Refreshed metrics as a Parquet table by category; comments of hand-written TOML are not kept anywhere."""
    entities.select("id", "category", "metrics").write.mode("overwrite").partitionBy("category").parquet(path)


def table_lines(values: Column, fields: list[str]) -> Column:
    """``key = value`` lines of a struct's numbers, flags and texts; null fields are left out."""
    text = F.from_json(F.to_json(values), "map<string,string>")
    typed = F.from_json(F.to_json(F.struct(values.alias("v"))), "v map<string,string>")["v"]

    def line(name: str) -> Column:
        raw, quoted = typed[name], F.to_json(F.struct(values[name].cast("string").alias("v")))
        plain = raw.rlike(r"^(?:-?\d+(?:\.\d+)?|true|false)$")
        return F.when(text[name].isNotNull(), F.concat(F.lit(f"{name} = "), F.when(plain, raw).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6)), F.lit("\n")))

    return F.concat(*(F.coalesce(line(f), F.lit("")) for f in fields))


def replace_table(text: Column, table: str, lines: Column) -> Column:
    """A TOML text whose table (with its sub-tables) holds ``lines``; all else, comments too, stays as written.

    See ``toml_text.put_table``; nulls stay null, and a text that isn't TOML is an error.
    """

    @F.arrow_udf("string")
    def put(texts: pa.Array, bodies: pa.Array) -> pa.Array:
        return pa.array([None if t is None or b is None else put_table(t, table, b) for t, b in zip(texts.to_pylist(), bodies.to_pylist(), strict=True)], pa.string())

    return put(text, lines)


def metrics_struct(forge: str | None, registry: str | None, stamp: Column) -> Column:
    """A fresh metrics struct from fetched columns: absent values are null, ``stale`` is false.

    Without forge values (an unsupported host) everything of the forge is dropped and
    ``archived`` is false.
    """
    f = (lambda n: F.col(f"{forge}.{n}")) if forge else (lambda n: F.lit(None))
    crate = F.when(F.col(registry).isNotNull(), F.struct(*(F.col(f"{registry}.{n}").alias(n) for n in ("name", "downloads_total", "downloads_recent", "latest_version", "latest_release", "msrv", "license")), F.coalesce(F.col(f"{registry}.owners"), F.array().cast("array<string>")).alias("owners"))) if registry else F.lit(None)
    return F.struct(
        *(f(n).cast("long").alias(n) for n in ("stars", "forks", "open_issues")),
        f("last_commit").cast("date").alias("last_commit"),
        F.coalesce(f("archived").cast("boolean"), F.lit(False)).alias("archived"),
        f("license").cast("string").alias("license"),
        stamp.cast("timestamp").alias("updated_at"),
        stamp.cast("string").alias("updated_at_raw"),
        F.lit(False).alias("stale"),
        F.lit(None).cast("string").alias("error"),
        crate.alias("crate"),
    )
