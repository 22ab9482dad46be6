"""Searches through the gram index against a scan."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.operators import filters, search_index
from catalith.operators.search_index import SearchIndex

ROWS = [
    (1, "Fuzzy Matcher", "finds things", ["Old One", None]), (2, "ÉCLAIR straße", None, []), (3, None, "fuzz", None), (4, "", "x", ["abc", "xyz abc"]), (4, "", "x", ["abc", "xyz abc"]),
    (5, "aaaaaaaaaa", "banana bandana", ["日本語のテキスト"]), (6, "long " * 5000 + "needle", "b", []), (7, "find", "ing", ["s"]), (None, "no id", "z", []),
]
NEEDLES = ["fuzz", " FUZZY m", "éclair", "x", "ab", "abc", "aaaa", "ana b", "本語", "needle", "", "  ", "nothing here", "finding", "%", "straße", "one", "g l"]
QUERIES = ["fuzz match", "things OLD", "", "abc x", "banana band ana", "needle long", "find ings", "no z", "nope no"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, name string, remarks string, needles array<string>").repartition(3)


def bag(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("block", [65_536, 2])
def test_like_a_scan(spark, rows, monkeypatch, block):
    monkeypatch.setattr(search_index, "BLOCK", block)
    index = SearchIndex.build(rows, ["name", "remarks"], ["needles"])
    got = index.search_any(NEEDLES).cache()
    for n in set(NEEDLES):
        assert bag(got.where(F.col("needle") == n).drop("needle")) == bag(filters.search_any(rows, n, ["name", "remarks"], ["needles"])), n
    hay = F.lower(F.concat_ws(" ", "name", "remarks", F.array_compact("needles")))
    got = index.search_all(QUERIES).cache()
    for q in QUERIES:
        assert bag(got.where(F.col("needle") == q).drop("needle")) == bag(filters.search_all(rows, q, hay)), q


def test_only_the_needles_lists_are_read(spark, rows):
    index = SearchIndex.build(rows, ["name", "remarks"], ["needles"])
    read = index.postings(["abc", "bcd"])
    assert {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} <= {str(b) for b in range(search_index.BUCKETS)}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "In(gram, [abc,bcd])" in plan
    assert index.postings([]).count() == 0 and index.search_any([""]).count() == 0
    empty = SearchIndex.build(rows.limit(0), ["name"])
    assert empty.search_any(["x"]).count() == 0 and empty.search_all(["", "a"]).count() == 0


@pytest.mark.parametrize(("block", "window"), [(2, 7), (65_536, 1000), (65_536, 2**20)])
def test_postings_hold_every_gram(spark, rows, monkeypatch, block, window):
    monkeypatch.setattr(search_index, "BLOCK", block)
    monkeypatch.setattr(search_index, "WINDOW", window)
    many = spark.createDataFrame([(9, "".join(chr(c) for c in range(0x4E00, 0x9E00)), "".join(chr(c) for c in range(0x10000, 0x24000)), None)], rows.schema)
    index = SearchIndex.build(rows.unionByName(many), ["name", "remarks"], ["needles"])
    got = {}
    for r in spark.read.parquet(f"{index.path}/grams").collect():
        assert (r.gram, r.block) not in got and len(r.gaps) == r.n
        places = [sum(r.gaps[: i + 1]) for i in range(r.n)] if r.n < 100 else []
        got[r.gram, r.block] = sorted(r.block * block + p for p in places)
        assert places == sorted(set(places))
    want = {}
    for r in index.rows().select("number", "fields").collect():
        for f in r.fields:
            for n in (1, 2, 3):
                for i in range(len(f) - n + 1):
                    want.setdefault((f[i : i + n], r.number // block), set()).add(r.number)
    assert got == {k: sorted(v) for k, v in want.items()}


def test_building_uses_all_cores(spark, rows):
    index = SearchIndex.build(rows.coalesce(1), ["name"])
    assert index.rows().select("part").distinct().count() > 1
