"""Facet counts over bitmaps against filtering state by state."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.scalars import compare_versions
from catalith.operators import bitmap_facets as B


def test_order_key(spark):
    versions = ["1", "1.0", "1.0.0", "1.2", "1.10", "0.9.9", "0", "", "x.1", "1.0.0.1", "99999999999999999999.1", "+2"]
    df = spark.createDataFrame([(a, b) for a in versions for b in versions], "a string, b string")
    x, y = B.order_key(F.col("a")), B.order_key(F.col("b"))
    same = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    assert df.where(~same.eqNullSafe(compare_versions(F.col("a"), F.col("b")))).count() == 0


def test_states(spark):
    rows = [(i, ["a", "b", None][i % 3], [f"t{i % 4}", f"t{i % 5}", None] if i % 7 else None, f"1.{i % 10}" if i % 6 else None) for i in range(100)] + [(3, "a", ["t3"], "1.3")] * 2
    df = B.numbered(spark.createDataFrame(rows, "id int, kind string, tags array<string>, version string").repartition(5))
    index = B.FacetIndex.build(df, {"kind": F.array("kind"), "tags": F.array_distinct("tags"), "version": F.array("version")}, ("version",))
    states = {
        1: [(B.ALL, [""])],
        2: [("kind", ["a", "b"]), ("tags", ["t1"])],
        3: [("version", ["1.4.0"]), ("kind", ["a"]), ("tags", ["t1", "t2"])],
        4: [("kind", ["nobody"]), (B.ALL, [""])],
        5: [("version", ["0.1"])],
        6: [("version", ["7"]), ("tags", ["t3"])],
    }

    def passes(row, facet, any_):
        if facet == "version":
            return row[3] is not None and any(int(row[3][2:]) <= {"1.4.0": 4, "0.1": -1, "7": 99}[v] for v in any_)
        return facet == B.ALL or any(v in ([row[1]] if facet == "kind" else row[2] or []) for v in any_ if v is not None)

    shown = index.visible(spark.createDataFrame([(s, f, a) for s, cs in states.items() for f, a in cs], "state int, facet string, any array<string>")).cache()
    want = {s: [r for r in rows if all(passes(r, *c) for c in cs)] for s, cs in states.items()}
    assert {r.state: r.n for r in B.counts(shown).collect()} == {s: len(v) for s, v in want.items() if v}
    got = {(r.state, r.value): r.n for r in index.by_value(shown, "tags").collect()}
    assert got == {(s, t): n for s, v in want.items() for t in ("t0", "t1", "t2", "t3", "t4") if (n := sum(t in (r[2] or []) for r in v))}
    marks = spark.createDataFrame([(2, "kind", "a"), (1, "kind", "b"), (6, "kind", "none")], "state int, facet string, value string")
    assert {r.state: r.n for r in B.counts(index.marked(shown, marks)).collect() if r.n} == {s: n for s, k in ((2, "a"), (1, "b")) if (n := sum(r[1] == k for r in want[s]))}
    empty = B.FacetIndex.build(B.numbered(df.drop("pos").limit(0)), {"kind": F.array("kind")})
    assert empty.visible(spark.createDataFrame([(1, B.ALL, [""])], "state int, facet string, any array<string>")).count() == 0
