"""Documents of several files with a manifest."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from catalith.sources import documents


def whole(path):
    return "".join(open(p).read() for p in documents.cat(str(path)))


def test_parts_put_together_are_the_document(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 3, F.lit("")).when(F.col("id") % 10 == 4, F.lit(None)).when(F.col("id") % 2 == 0, F.concat(F.lit("é line "), "id", F.lit("\nsecond\n"))).otherwise(F.concat(F.lit("row "), "id")).alias("t"))
        documents.write(rows.repartition(7), "t", [F.desc("id")], str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = "".join("" if i % 10 in (3, 4) else f"é line {i}\nsecond\n" if i % 2 == 0 else f"row {i}\n" for i in range(1999, -1, -1))
    assert whole(tmp_path / "d") == want and len(documents.cat(str(tmp_path / "d"))) > 1
    for p, path in zip(documents.manifest(str(tmp_path / "d")), documents.cat(str(tmp_path / "d")), strict=True):
        data = open(path, "rb").read()
        assert (p["bytes"], p["lines"], p["sha256"]) == (len(data), data.count(b"\n"), hashlib.sha256(data).hexdigest())
    got = documents.read(spark, f"file://{tmp_path}/d")
    assert got.rdd.getNumPartitions() == len(documents.cat(str(tmp_path / "d")))
    assert [r.line for r in got.orderBy("line_no").collect()] == want.split("\n")[:-1]


def test_a_failed_job_leaves_the_document(spark, tmp_path):
    at = str(tmp_path / "d")
    documents.write(spark.range(10).select("id", F.col("id").cast("string").alias("t")), "t", [F.asc("id")], at)
    before = whole(at)
    bad = spark.range(10).select("id", F.when(F.col("id") == 9, F.raise_error(F.lit("no")).cast("string")).otherwise("x").alias("t"))
    with pytest.raises(Exception, match="no"):
        documents.write(bad, "t", [F.asc("id")], at)
    assert whole(at) == before
    documents.write(spark.range(3).select("id", F.lit("new").alias("t")), "t", [F.asc("id")], at)
    assert whole(at) == "new\n" * 3 and len(os.listdir(at)) == len(documents.cat(at)) + 1
    documents.write(spark.range(0).select("id", F.lit("").alias("t")), "t", [F.asc("id")], at)
    assert documents.cat(at) == [] and documents.read(spark, at).count() == 0
