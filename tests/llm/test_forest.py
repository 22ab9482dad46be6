"""The hash-prefix forest against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from catalith.llm import forest, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, _rep string"


def brute(rows, k, every):
    """{query: [(score, id)]} of every other row, best first, of equal length; an id counts once."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, x in good:
        if i % every == 0:
            best = {}
            for j, y in good:
                if j != i and len(x) == len(y):
                    best[j] = max(best.get(j, -np.inf), float(np.cumsum(y * x)[-1]))
            out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def listed(result):
    found = defaultdict(list)
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((-r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def fixture(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)]  # copies: a third of all rows
    rows += [(450 + i, (np.array(rows[9][1]) + rng.normal(size=8) * 1e-3).astype(np.float32).tolist()) for i in range(100)]
    rows += [(600 + i, (np.array(rows[i][1]) * 3).astype(np.float32).tolist()) for i in range(10)]
    rows += [(700, rng.normal(size=5).tolist()), (705, rng.normal(size=5).tolist()), (710, None), (715, []), (720, [0.0] * 8), (725, [1.0, None] * 4), (730, [float("nan")] * 8)]
    rows += [(735, [float("inf")] * 8), (None, rng.normal(size=8).tolist()), (300, rows[7][1]), (740, [1.0])]
    return [(i, v, 1, "own", "own") for i, v in rows]


@pytest.mark.parametrize("cell", [2**20, 40])
def test_exact_forest_is_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(forest, "CELL", cell)
    monkeypatch.setattr(forest, "SLICE", 8 * 50)
    monkeypatch.setattr(forest, "VISITORS", 8 * 20)
    rows = fixture()
    got = listed(forest.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k=7, every=5, target_recall=1))
    want = {q: near for q, near in brute(rows, 7, 5).items() if near}
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [j for _, j in got[q]] == [j for _, j in near] and np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-12), q


@pytest.mark.parametrize(("cell", "norms"), [(2**20, False), (100, True)])
def test_recall_and_candidates(spark, monkeypatch, cell, norms):
    """Recall on clustered vectors, with fewer rows compared than there are."""
    monkeypatch.setattr(forest, "CELL", cell)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 2000)] + 0.4 * rng.normal(size=(2000, 24)) + 2
    x *= rng.uniform(0.7, 1.3, size=(2000, 1)) if norms else 1 / np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist(), 1, "", "") for i, v in enumerate(x.astype(np.float32))]
    levels = {}
    plain = forest.required

    def required(found, counts, target):
        levels["m"] = plain(found, counts, target)
        return levels["m"]

    monkeypatch.setattr(forest, "required", required)
    got = listed(forest.nearest(spark.createDataFrame(rows, SCHEMA), k=20, every=20))
    want = brute(rows, 20, 20)
    assert len(got) == len(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({j for _, j in want[q]} & {j for _, j in got[q]}) / 20 for q in want]) >= 0.9
    assert levels["m"] < 16 * 2000 / 4


def test_strings_share_prefixes():
    a, b = np.array([0, 1 << 63, 7, 5], np.uint64), np.array([0, 0, 6, 5], np.uint64)
    assert forest.shared_bits(a, b).tolist() == [64, 0, 63, 64]
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    for d in (0, 1, 5, 9, 63, 64):
        lo, hi = forest.span(keys, keys[::50], d)
        assert all((forest.shared_bits(keys, np.full(500, q)) >= d).sum() == h - n for q, n, h in zip(keys[::50], lo, hi, strict=True))


def test_empty_and_query(spark):
    assert forest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert forest.nearest(spark.createDataFrame([(20, [1.0, 2.0], 1, "", "")], SCHEMA)).count() == 0
    data = "/root/testdata/sf0.001"
    got = listed(queries.op11_hash_prefix_forest(spark, data))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({j for _, j in want[q]} & {j for _, j in got[q]}) / 20 for q in want]) >= 0.9
