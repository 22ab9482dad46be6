"""Responses as variants, keyword scans with bad pages, and paged listings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalith.operators.paging import PagedListing
from catalith.sources import captured



def test_fields_have_their_types(spark):
    rows = [
        ("long", '{"stargazers_count": 3, "archived": true, "other": [1]}', 3), ("text number", '{"stargazers_count": "3"}', None), ("fraction", '{"stargazers_count": 3.5}', None), ("huge", '{"stargazers_count": 99999999999999999999}', None),
        ("null", '{"stargazers_count": null}', "null"), ("text flag", '{"stargazers_count": 1, "archived": "true"}', None), ("no object", "[1]", None), ("broken", '{"stargazers_count": 1', None), ("twice", '{"a": 1, "a": 2}', None), ("blank", "  ", None), ("none", None, None),
        ("licence", '{"stargazers_count": 5, "license": {"spdx_id": "NOASSERTION"}}', 5), ("spaces", ' {"stargazers_count": 6} ', 6),
    ]
    df = spark.createDataFrame([(i, "github.com", b, None, 200) for i, b, _ in rows], "id string, kind string, body string, error string, status int")
    got = {r.id: r for r in captured.normal_responses(df).collect()}
    for i, _, want in rows:
        if want is None:
            assert got[i].forge_error == captured.UNREADABLE and got[i].forge is None, i
        else:
            assert got[i].forge_error is None and got[i].forge.stars == (None if want == "null" else want) and got[i].forge.license is None, i
    assert captured.normal_responses(df.limit(0)).count() == 0


def test_best_of_repeated_responses_and_one_scan(spark, tmp_path):
    rows = [("a", "github.com", "<html>", None, 200), ("a", "github.com", '{"stargazers_count": 1}', None, 200), ("a", "owners", '{"users": [{"login": "x"}, {}]}', None, 200), ("a", "registry", '{"crate": {"downloads": 4}, "versions": []}', None, 200), ("b", "registry", '{"errors": []}', None, 200), ("c", "odd", "{}", None, 200)]
    spark.createDataFrame(rows, "id string, kind string, body string, error string, status int").write.json(str(tmp_path / "r"))
    out = captured.normal_responses(captured.read_responses(spark, str(tmp_path / "r")))
    got = {r.id: r for r in out.collect()}
    assert got["a"].forge.stars == 1 and got["a"].registry.owners == ["x"] and got["a"].registry.downloads_total == 4 and got["b"].registry_error == captured.UNREADABLE and got["c"].forge is None
    entities = spark.createDataFrame([("a", "a", "https://github.com/o/r")], "id string, crate string, repository string")
    plan = captured.outcomes(entities, captured.read_responses(spark, str(tmp_path / "r")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json") == 1


def test_a_bad_page_is_reported(spark):
    pages = spark.createDataFrame([(1, '{"crates": [{"name": "a", "recent_downloads": 2}, {"name": null}]}', None), (2, "<html>", None), (3, '{"crates": []}', None), (4, None, "timed out")], "page int, body string, error string")
    read = captured.read_pages(pages)
    assert sorted((r.page, r.name or "", r.page_error or "") for r in read.collect()) == [(1, "", ""), (1, "a", ""), (2, "", captured.UNREADABLE), (4, "", "timed out")]
    with pytest.raises(Exception, match="page [24]: "):
        captured.discover(read, 10).collect()
    assert [r.name for r in captured.discover(read, 10, strict=False).collect()] == ["a", None]
    assert captured.discover(captured.read_pages(pages, 1), 10).count() == 2


def test_pages_read_their_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("v"), F.col("id").alias("n"))
    paged = PagedListing.build(rows.repartition(5), F.struct((-F.col("v")).alias("v"), F.col("n").alias("n")), ranges=8)
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert len(paged.ranges) > 4
    for number, size in ((0, 10), (3, 100), (9, 100), (10, 100), (0, 1000), (1, 999)):
        assert [(r.v, r.n) for r in paged.page(number, size).collect()] == want[number * size : (number + 1) * size]
    for at in (0, 7, 500, 998, 999):
        v, n = want[at]
        cursor = F.struct(F.lit(-v).cast("long").alias("v"), F.lit(n).cast("long").alias("n"))
        got = paged.after(cursor, 50)
        assert [(r.v, r.n, r.place) for r in got.collect()] == [(*x, at + 1 + i) for i, x in enumerate(want[at + 1 : at + 51])]
    before = F.struct(F.lit(-99).cast("long").alias("v"), F.lit(0).cast("long").alias("n"))
    assert [(r.v, r.n) for r in paged.after(before, 5).collect()] == want[:5]
    for df in (paged.page(3, 100), paged.after(before, 5)):
        assert "_range#" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters")[0]
    none = PagedListing.build(rows.limit(0), F.struct("v", "n"))
    assert none.page(0, 10).count() == 0 and none.after(before, 5).count() == 0
