"""Declared schemas of the catalog; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DateType()
_NAMES = T.ArrayType(T.StringType())

CRATE = T.StructType(
    [
        T.StructField("name", _S),
        T.StructField("downloads_total", _L),
        T.StructField("downloads_recent", _L),
        T.StructField("latest_version", _S),
        T.StructField("latest_release", _D),
        T.StructField("msrv", _S),
        T.StructField("license", _S),
        T.StructField("owners", _NAMES),
    ]
)
METRICS = T.StructType(
    [
        T.StructField("stars", _L),
        T.StructField("forks", _L),
        T.StructField("open_issues", _L),
        T.StructField("last_commit", _D),
        T.StructField("archived", _B),
        T.StructField("license", _S),
        T.StructField("updated_at", T.TimestampType()),
        # the stamp as written: Spark keeps microseconds, sources may hold nanoseconds
        T.StructField("updated_at_raw", _S),
        T.StructField("stale", _B),
        T.StructField("error", _S),
        T.StructField("crate", CRATE),
    ]
)
ENTITY = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("name", _S),
        T.StructField("repository", _S),
        T.StructField("category", _S),
        T.StructField("remarks", _S),
        T.StructField("crate", _S),
        T.StructField("installable", _B),
        T.StructField("homepage", _S),
        T.StructField("alternatives", _NAMES),
        T.StructField("successors", _NAMES),
        T.StructField("related", _NAMES),
        T.StructField("recommended", _B),
        T.StructField("added", _D),
        T.StructField("metrics", METRICS),
    ]
)
PICK = T.StructType([T.StructField("tool", _S), T.StructField("note", _S)])
STACK = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("description", _S), T.StructField("intro", _S), T.StructField("picks", T.ArrayType(PICK, containsNull=False))])
CATEGORY = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("id", _S), T.StructField("name", _S), T.StructField("description", _S)])

#: Keys without which a record is malformed, and what absent optional keys become.
REQUIRED = {"entity": ["id", "name", "repository", "category"], "stack": ["id", "name"], "category": ["id", "name"], "pick": ["tool"], "crate": ["name"]}
DEFAULTS = {
    "entity": {"remarks": "", "installable": True, "alternatives": [], "successors": [], "related": [], "recommended": False},
    "metrics": {"archived": False, "stale": False},
    "crate": {"owners": []},
    "stack": {"description": "", "intro": "", "picks": []},
    "pick": {"note": ""},
    "category": {"description": ""},
}
