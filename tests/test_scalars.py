"""Table-driven cases of the column functions, boundaries included."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith.functions import scalars as S


def values(spark, rows, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_version_key(spark):
    got = values(spark, ["1.65", "1.65.1", "x.2", "1. 7 .3.9", "", None, "99999999999.1"], "string", S.version_key)
    assert [tuple(g) if g else None for g in got] == [(1, 65, 0), (1, 65, 1), (0, 2, 0), (1, 7, 3), (0, 0, 0), None, (0, 1, 0)]


def test_compare_versions(spark):
    rows = [("1.65", "1.65.1", -1), ("1.10", "1.9", 1), ("1.74", "1.74.0", 0), ("1.2.3.4.5", "1.2.3.4", 1), (None, "1", None)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", S.compare_versions(F.col("a"), F.col("b"))).collect())


def test_license_families(spark):
    rows = ["MIT OR Apache-2.0", "Apache-2.0/MIT", "GPL-3.0+", "GPL-3.0-or-later", "LGPL-2.1-only AND MIT", "MIT/MIT", "", None, "GPL-3.0-only-or-later+"]
    assert values(spark, rows, "string", S.license_families) == [["MIT", "Apache-2.0"], ["Apache-2.0", "MIT"], ["GPL-3.0"], ["GPL-3.0"], ["LGPL-2.1", "MIT"], ["MIT"], [], None, ["GPL-3.0"]]


@pytest.mark.parametrize("unit", [50, 50_000])
def test_compact_is_exact_at_ties(spark, unit):
    ns = [n * unit for n in range(1, 4000)] + [999, 1000, 1150, 1250, 999_950, 999_999, 1_000_000, 2**53 - 1]

    def want(n):
        return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}k" if n >= 1000 else str(n)

    assert values(spark, ns, "long", S.compact) == [want(n) for n in ns]


def test_relative_date(spark):
    today = dt.date(2024, 3, 1)
    days = [-5, 0, 1, 6, 7, 29, 30, 364, 365, 800]
    got = values(spark, [today - dt.timedelta(d) for d in days], "date", lambda c: S.relative_date(c, F.lit(today)))
    assert got == ["today", "today", "1d ago", "6d ago", "1w ago", "4w ago", "1mo ago", "12mo ago", "1y ago", "2y ago"]
    assert values(spark, [None], "date", lambda c: S.relative_date(c, F.lit(today))) == [None]


def test_is_new(spark):
    today = dt.date(2024, 3, 1)
    got = values(spark, [today - dt.timedelta(d) for d in (0, 29, 30, -1)] + [None], "date", lambda c: S.is_new(c, F.lit(today)))
    assert got == [True, True, False, False, False]


def test_stamp_date_keeps_its_own_offset(spark):
    rows = ["2024-01-01T23:30:00-05:00", "2024-01-01T00:10:00.123456789+09:00", "2024-01-01T00:10:00Z", "2024-02-30T00:00:00Z", "2024-01-01", None, "2024-01-01T25:00:00Z"]
    day = dt.date(2024, 1, 1)
    assert values(spark, rows, "string", S.stamp_date) == [day, day, day, None, None, None, None]


def test_text_functions(spark):
    assert values(spark, ["cargo-x (old)", " a ", "(b)", None], "string", S.relation_name) == ["cargo-x", "a", "", None]
    assert values(spark, ["\t a b \n", " x "], "string", S.trim_all) == ["a b", "x"]
    assert values(spark, ["<a & 'b' \"c\">"], "string", S.xml_escape) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]
    assert values(spark, ["ÀB", "Zz"], "string", S.ascii_lower) == ["Àb", "zz"]
    assert values(spark, ["a\r\nb\n", "", "x\n\ny"], "string", S.indent_lines) == [["  a", "  b"], [], ["  x", "  ", "  y"]]
    assert values(spark, [0, 999, 1000, 4821330], "long", S.thousands) == ["0", "999", "1,000", "4,821,330"]


def test_urls(spark):
    rows = ["https://github.com/a/b.git/", "http://gitlab.example.org/x/y", "https://github.com/only", "not a url", None]
    assert values(spark, rows, "string", S.repo_label) == ["a/b.git", "gitlab.example.org/x/y", "only", "not a url", None]
    assert values(spark, rows, "string", S.is_gitlab) == [False, True, False, False, None]
    got = values(spark, rows, "string", S.owner_repo)
    assert [tuple(g) if g else None for g in got] == [("a", "b"), ("x", "y"), None, None, None]


def test_relevance_and_status(spark):
    rows = [(0, 5, 9), (None, 5, 9), (None, None, 9), (None, None, None)]
    df = spark.createDataFrame(rows, "r long, t long, s long")
    assert [x[0] for x in df.select(S.relevance(F.col("r"), F.col("t"), F.col("s"))).collect()] == [0, 5, 9, 0]
    df = spark.createDataFrame([(True, True), (False, True), (None, None)], "a boolean, s boolean")
    assert [x[0] for x in df.select(S.status_label(F.col("a"), F.col("s"))).collect()] == ["Deprecated", "Stale", "Maintained"]
