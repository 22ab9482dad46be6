"""The prefix trie of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from catalith.llm import oracles, prefixes, queries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    key = lambda v: (v[:2], hashlib.sha256(f"{len(v[2].encode())}:{v[2]}{v[3]}".encode()).digest())
    own = {c: [v[2:] for v in sorted(vs, key=key)] for c, vs in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + path[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [out[c] for c in children[p]]
        leaves, saved = sum(b[5] for b in below) or 1, sum(b[6] for b in below) + (len(members[p]) - 1) * words
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, sha)
    return sorted(out.values(), key=str)


def fixture():
    rng = random.Random(2)
    rows = []
    for c in range(120):
        n = rng.choice([0, 1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "go on please", ""])) for t in range(n)]
    same = [(t, "user" if t % 2 else "system", f"shared turn {t} of many words") for t in range(12)]
    for c in range(200, 320):  # a third of all share a long beginning, many are copies
        rows += [(c, *s) for s in same] + ([(c, 12, "user", f"own {c % 7}"), (c, 13, "user", f"last {c % 3}")] if c % 3 else [])
    rows += [(400, None, None, None), (400, 1, None, "a\nb  c"), (400, 1, "user", "tie"), (400, 1, "user", "tie"), (None, 0, "user", "lost"), (401, 0, "us", "er"), (402, 0, "user", ""), (-7, 0, "user", "minus"), (-20, 0, "system", "base")]
    rows += [(440, t, "user", f"turn {t}") for t in range(700)] + [(441, t, "user", f"turn {t}") for t in range(650)]
    rows += [(460, 0, "user", "long " * 40_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bucket", "limit", "piece"), [(8_000, 32_000, 4096), (50, 60, 3), (1, 1, 1)])
def test_trie(spark, monkeypatch, bucket, limit, piece):
    for name, value in (("BUCKET", bucket), ("LIMIT", limit), ("PIECE", piece)):
        monkeypatch.setattr(prefixes, name, value)
    rows = fixture() if limit > 1 else [r for r in fixture() if r[0] is None or r[0] < 30]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(3)
    got = sorted((tuple(r) for r in prefixes.trie(df).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_query(spark):
    assert prefixes.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    data = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in queries.op13_conversation_trie(spark, data).select(*COLUMNS).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.OP13})").fetchall(), key=str) == got
