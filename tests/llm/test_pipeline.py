"""The pipeline against a brute-force version of its stages, and the registration of its queries."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from test_operators import BASE, brute_pseudonym, drawn, least_reachable, measured, shingle_set, texts

import corpus_pipeline
from catalith.llm import quality
from catalith.llm import queries as llm


PRIVATE = ["ab.9@mail.example.com", "x7y@b.co"]


def rows():
    rng = np.random.default_rng(9)
    out = [(i, t, "en", s, len(t or "")) for i, t, s, *_ in texts()]
    out += [(60 + i, f"{' '.join(BASE[i:])} write to {PRIVATE[i]} or to {PRIVATE[1 - i]} today, number {i}", "en", "s1", 0) for i in range(2)]
    for g in range(15):
        words = [f"{BASE[rng.integers(len(BASE))]}{rng.integers(50)}" for _ in range(80)]
        for c in range(1 + g % 4):
            own = list(words)
            own[rng.integers(80)] = "changed" if c else own[0]
            out.append((100 + 10 * g + c, " ".join(own), "en", f"s{g % 3}", 0))
    return out


def keeps(t):
    n, chars, symbols, dup, repeat = measured(t)
    t = t or ""
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
    upper = sum(c.isupper() for c in t)
    return not (n < 20 or 100 * repeat > 30 * n or 10 * symbols > n or 100 * dup > 40 * len(lines) or chars < 3 * n or chars > 10 * n or 2 * upper > chars)


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows() if keeps(r[1])]
    sets = {r[0]: shingle_set(r[1], 5) for r in kept if r[0] is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = least_reachable(sets, links)
    kept = [r for r in kept if r[0] is None or component[r[0]] == r[0]]
    hidden = {v: brute_pseudonym("email", v, corpus_pipeline.PII_KEY) for v in PRIVATE}
    kept = [(i, re.sub("|".join(map(re.escape, hidden)), lambda m: hidden[m[0]], t), *rest) for i, t, *rest in kept]
    assert sum(any(h in t for h in hidden.values()) for _, t, *_ in kept) == 2
    n = Counter(r[3] for r in kept)
    rate = {s: k**0.5 / sum(x**0.5 for x in n.values()) * sum(n.values()) / k for s, k in n.items()}
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in kept:
        ids = [*tk.encode(r[1], add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(r[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += drawn(rate[r[3]], corpus_pipeline.MIX_SEED, "" if r[0] is None else str(r[0]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert links and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame([(1, "x", "en", "s", 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, _gone int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.limit(0), "").count() == 0


def test_registration():
    names = set(llm.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(llm.oracle_sql()) <= names and quality.POLICIES["v1"] & quality.POLICIES["base"] == quality.POLICIES["base"]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracles(spark, name):
    import os

    import duckdb

    sf = os.environ.get("CATALITH_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = llm.queries()[name](spark, sf)
    columns = sorted(df.columns)
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall()), key=repr)


def test_bench_times_every_llm_query_and_the_pipeline():
    import bench
    from catalith.llm import queries

    assert {*queries.QUERIES, "pipeline"} <= set(bench.HEADLINE)
