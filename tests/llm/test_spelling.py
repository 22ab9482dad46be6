"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from catalith.llm import oracles, queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, modulus, least_length, least):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def fixture():
    rng = random.Random(4)
    words = ["".join(rng.choice("abÉéx÷") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=60)).replace("x", "X", i % 3)) for i in range(40)]
    hot = "frequent " * 2000 + "frequnt frequnt frequnt frequents frequents frequents frequent1frequent"
    rows += [(None, "Alpha alpha ALPHA alphab alphab alphab"), (41, None), (42, ""), (43, " \n1234"), (44, hot), (44, hot), (45, "z" * 30_000 + " " + "z" * 29_999), (46, "z" * 30_000), (46, "z" * 30_000)]
    rows += [(60 + i, "delta " * 20 + "deltaz " * 8 + "deltazy " * 3) for i in range(6)]
    rows += [(47, "ßtraße ßtraße ßtraße strasse ŁódźŁódź 日本abcde日本abcde日本abcde \x00abcde")]
    return rows


@pytest.mark.parametrize(("shard", "wave", "states"), [(2_000_000, 2**26, 400_000), (200, 3000, 500)])
def test_variants(spark, monkeypatch, shard, wave, states):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "WAVE", wave)
    monkeypatch.setattr(spelling, "STATES", states)
    monkeypatch.setattr(spelling, "TASK", 60)
    monkeypatch.setattr(spelling, "HELD", 50)
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in fixture()], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.group_variants(df, modulus=5, least_length=4, least=2).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = brute(fixture(), 5, 4, 2)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[3] for w in want) and any(w[5] != w[3] for w in want if w[3])


def test_automaton_against_all_pairs():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randint(1, 7))) for _ in range(1500)} | {b"x" * 400, b"x" * 401, b"x" * 399 + b"y"})
    trie = spelling.Trie.unpacked(*spelling.Trie.of(words, np.arange(len(words))).packed().values())
    i, j = spelling.neighbours(trie, words)
    got = list(zip(i.tolist(), j.tolist(), strict=True))
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if a != b and one_edit(x.decode("latin-1"), y.decode("latin-1"))}
    assert not len(spelling.neighbours(spelling.Trie.of([b"abc"], np.array([1])), [])[0])


def test_empty_and_query(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    data = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op12_spelling_variants(spark, data).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got == set(con.sql(oracles.OP12).fetchall())
