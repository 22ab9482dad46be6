"""Each operator against brute force, on a fixture of nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from catalith.llm import chat, ctw, embeddings, graph, jaccard, mixing, packing, pii, quality, queries, tokens, warc
from catalith.plans.storage import table_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a very old oak tree near the river bank".split()
LONG = " ".join(f"w{i % 9000}x{i % 7}" for i in range(30_000))


def texts():
    near = " ".join(BASE * 3)
    rows = [
        (1, " ".join(BASE)), (2, None), (3, ""), (4, " ".join(BASE)), (4, " ".join(BASE)), (None, "no id here"), (5, near), (6, near + " tail"),
        (7, LONG), (8, LONG + " end"), (9, "a b"), (10, "A B"), (11, " \t\n"), (12, "é" * 50 + " ▁x  y <s> a"), (13, "one\none\n\none two\n"),
        (14, "### *** %%% |||" * 30), (15, "x" * 50_000), (16, " ".join(BASE[::-1])), (17, "THE Quick brown fox"), (18, "the quick Brown FOX"),
    ]
    return [(i, t, f"s{(i or 0) % 3}" if i != 9 else None, "own", "own") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, source string, rate string, n_words string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def multiset(rows):
    return Counter(map(tuple, rows))


# quality -----------------------------------------------------------------------------


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    got = quality.apply_policy(quality.ledger(docs.select("doc_id", "text", "n_words")), "v1").collect()
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == multiset((i, *measured(t)) for i, t, *_ in texts())
    assert all(r.kept == (r.fail_mask == 0) for r in got) and any(r.kept for r in got)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and multiset(kept.select("doc_id").collect()) == multiset((r.doc_id,) for r in got if r.kept)
    assert quality.keep_documents(none).count() == 0
    masks = [r.fail_mask for r in got]
    for r in quality.ablation(quality.ledger(docs.select("doc_id", "text")), "v1").collect():
        bit = quality.BIT[r.rule]
        assert (r.n_failed, r.n_only_this, r.n_kept_without) == (sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m & ~bit == 0 for m in masks))


# personal data -----------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(spark, docs, none):
    kinds = {
        "card": ["4111-1111-1111-1111", "5500 0000 0000 0004", "340000000000009"],
        "phone": ["+1 (017) 555-7713", "+1 743-555-3824"],
        "ssn": ["078-05-1120", "899-99-9999", "667-01-0001"],
        "ip": ["0.0.0.0", "255.255.255.255", "10.1.2.3"],
        "date": ["1900-01-01", "2000-02-29", "2100-01-01"],
        "email": ["Éu.x9@mail.example.com", "a.77@b.co"],
    }
    plain = ["4111111111111112", "2023-02-30", "666-12-1234", "300.1.1.1", "1.2.3", "12345", "a@b", "2100-01-02"]
    rows = [(f"x {v}, y", k) for k, vs in kinds.items() for v in vs] + [(f"x {v}, y", None) for v in plain] + [('token = "00ffAB12cd34ef56aa"', "token")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "text string, kind string").withColumn("old", F.col("text")), "key").collect()
    for r in got:
        if r.kind is None:
            assert r.text == r.old and r.pii == []
            continue
        (hit,) = r.pii
        new = hit.pseudonym
        assert hit.kind == r.kind and new != hit.original and r.text == r.old.replace(hit.original, new)
        assert len(new) == len(hit.original) or r.kind == "ip"
        if r.kind == "card":
            assert luhn(re.sub(r"\D", "", new)) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", hit.original)
    again = pii.pseudonymise(spark.createDataFrame([(r.text,) for r in got if r.kind], "text string"), "key").collect()
    assert Counter(x.kind for r in again for x in r.pii) == Counter(r.kind for r in got if r.kind)  # formats survive
    done = pii.pseudonymise_documents(docs, "key")
    assert done.columns == docs.columns and multiset(done.collect()) == multiset(docs.collect())
    assert pii.pseudonymise_documents(none, "key").count() == 0


def feistel_hash(key, kind, i, other):
    return hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()


def feistel_pair(key, kind, left, right, a, b):
    for i in range(8):
        if i % 2 == 0:
            left = (left + int(feistel_hash(key, kind, i, right)[:12], 16)) % a
        else:
            right = (right + int(feistel_hash(key, kind, i, left)[:12], 16)) % b
    return left, right


PLAIN = [range(48, 58), range(97, 123), range(65, 91), range(0xE0, 0xF7), range(0xC0, 0xD7)]


def feistel_text(key, kind, value, classes=PLAIN):
    """Both halves in turn, each character moved within its class by a stream made of the other half."""

    def stream(half, i, other):
        seed, out = feistel_hash(key, kind, i, other), ""
        for j, ch in enumerate(half):
            by = int(hashlib.sha256(f"{seed}{j}".encode()).hexdigest()[:8], 16)
            own = next((c for c in classes if ord(ch) in c), None)
            out += ch if own is None else chr(own[(ord(ch) - own[0] + by) % len(own)]) if isinstance(own, range) else chr(own[(own.index(ord(ch)) + by) % len(own)])
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            left = stream(left, i, right)
        else:
            right = stream(right, i, left)
    return left + right


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def brute_pseudonym(kind, v, key):
    import datetime as dt

    d = re.sub(r"\D", "", v)
    if kind == "card":
        body = d[0] + feistel_text(key, "card", d[1:-1])
        return refill(v, next(body + str(c) for c in range(10) if luhn(body + str(c))))
    if kind == "phone":
        fixed = 0 if not v.startswith("+") else 1 if d[0] in "17" else 2 if d[:2] in ("44", "49", "33") else 3
        return refill(v, d[:fixed] + feistel_text(key, "phone", d[fixed:]))
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        left, right = feistel_pair(key, "ssn", (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        return f"{left // 99 + (2 if left // 99 >= 665 else 1):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        pair = feistel_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return ".".join(str(x) for p in pair for x in (p // 256, p % 256))
    if kind == "date":
        days = (dt.date.fromisoformat(v) - dt.date(1900, 1, 1)).days
        left, right = feistel_pair(key, "date", days // 487, days % 487, 150, 487)
        return (dt.date(1900, 1, 1) + dt.timedelta(left * 487 + right)).isoformat()
    if kind == "email":
        name, at, domain = v.rpartition("@")
        return feistel_text(key, "email", name) + at + domain
    small, capital = range(97, 103), range(65, 71)
    return feistel_text(key, "token", v, [range(48, 58), small, capital] if re.search("[A-F]", v) else [[ord(c) for c in "0123456789abcdef"]])


def test_pseudonyms_equal_an_independent_network(spark):
    values = {
        "card": ["4111-1111-1111-1111", "5500 0000 0000 0004", "340000000000009", "4111111111111111"],
        "phone": ["+1 (017) 555-7713", "+1 743-555-3824", "+44 20 7946 0958", "212-555-0187"],
        "ssn": ["078-05-1120", "899-99-9999", "667-01-0001", "001-01-0001"], "ip": ["0.0.0.0", "255.255.255.255", "10.1.2.3"], "date": ["1900-01-01", "2000-02-29", "2099-12-31"],
        "email": ["Éu.x9@mail.example.com", "a.77@b.co", "x@y.zz"], "token": ["00ffab12cd34ef56aa", "00FFAB12CD34EF56AA", "aBcdef0123456789", "abcdef0123456789"],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs]
    got = spark.createDataFrame(rows, "kind string, v string").select("kind", "v", pii.pseudonym(F.col("kind"), F.col("v"), "key").alias("p")).collect()
    assert {(r.kind, r.v): r.p for r in got} == {(k, v): brute_pseudonym(k, v, "key") for k, v in rows}
    tokens_ = [r.p for r in got if r.kind == "token"]
    assert len(set(tokens_)) == 4


def test_tokens_of_any_case_stay_different(spark):
    small = spark.range(4096).select(pii.pseudonym(F.lit("token"), F.lpad(F.lower(F.hex("id")), 3, "0"), "k").alias("p"))
    assert len({r.p for r in small.collect()}) == 4096
    mixed = ["".join(x) for x in product("a0F", "bB1", "cC", "Dd9")]
    got = [r.p for r in spark.createDataFrame([(m,) for m in mixed], "v string").select(pii.pseudonym(F.lit("token"), F.col("v"), "k").alias("p")).collect()]
    assert len(set(got)) == len(mixed)


def test_pii_neighbours(spark):
    rows = [
        ("4111111111111111 5 items", ["4111111111111111"]),
        ("4111-1111-1111-1111 123", ["4111-1111-1111-1111"]),
        ("5500000000000004 078-05-1120", ["5500000000000004", "078-05-1120"]),
        ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        ("12 4111111111111111", ["4111111111111111"]),
        ("5500000000000004 10.1.2.3", ["5500000000000004", "10.1.2.3"]),
        ("5500000000000004-10.1.2.3", ["5500000000000004", "10.1.2.3"]),
        ("7 3400 000000 00009 2001-02-03 8", ["3400 000000 00009", "2001-02-03"]),
        ("078-05-1120 4111111111111111", ["078-05-1120", "4111111111111111"]),
        ("4111111111111111 5a@b.co", ["4111111111111111", "5a@b.co"]),
        ("4111 1111 1111 1111 5500 0000 0000 0004-1", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
        ("9 41 11 11 11 11 11 11 11 3", ["41 11 11 11 11 11 11 11"]),
        ("1.5 4111111111111111.25", ["4111111111111111"]),
        ("4111111111111112 5 items", []),
        ("1 " * 3000 + "4111111111111111", ["4111111111111111"]),
        ('token = "1234567890123abcdef" 12345678901234567890 4111111111111111', ["1234567890123abcdef", "4111111111111111"]),
    ]
    got = pii.pseudonymise(spark.createDataFrame(rows, "text string, want array<string>").withColumn("old", F.col("text")), "key").collect()
    for r in got:
        assert [x.original for x in r.pii] == r.want, r.old[-60:]
        new = r.old
        for x in r.pii:
            new = new.replace(x.original, x.pseudonym)
        assert r.text == new


def test_pii_other_formats(spark):
    kinds = {
        "phone": ["415-555-2671", "(415) 555-2671", "415.555.2671", "415 555 2671", "+44 20 7946 0958", "+493012345678", "+7 (495) 123-45-67", "+14155552671"],
        "date": ["2001/02/03", "12/31/1999", "1/5/2020", "31.12.1999", "5.1.2020"],
        "token": ["deadbeefdeadbeef", "00FFAB12CD34EF56AA"],
        "email": ["иван@mail.com", "Ωμέγα.7@mail.com", "山田太郎@mail.com", "østerløkke@mail.com", "Łukasz@mail.com"],
    }
    shapes = {"token": ["api_key: '{}'", "SECRET={}"]}
    plain = ["x 31/12/1999", "x 31.02.1999", "x 13/13/2000", "x 1.2.3", "sha deadbeefdeadbeef", "x 1 415 555 2671 9"]
    rows = [(f.format(v), k, v) for k, vs in kinds.items() for v in vs for f in shapes.get(k, ["x {}, y", "5500000000000004 {}"])] + [(t, None, None) for t in plain]
    got = pii.pseudonymise(spark.createDataFrame(rows, "text string, kind string, value string").withColumn("old", F.col("text")), "key").collect()
    for r in got:
        hits = [x for x in r.pii if x.kind != "card"]
        if r.kind is None:
            assert hits == [] and r.text == r.old
            continue
        if r.value == "415 555 2671" and r.old.startswith("5500"):
            continue  # beside other numbers this is no phone
        (hit,) = hits
        assert (hit.kind, hit.original) == (r.kind, r.value) and hit.pseudonym != r.value, r.old
        assert r.value not in r.text and hit.pseudonym in r.text
        if r.kind == "email":
            assert not set(r.value.split("@")[0]) <= set(hit.pseudonym.split("@")[0])
    again = pii.pseudonymise(spark.createDataFrame([(r.text,) for r in got if r.kind], "text string"), "key").collect()
    assert Counter(x.kind for r in again for x in r.pii) == Counter(x.kind for r in got for x in r.pii if r.kind)
    names = [f"{chr(0x430 + i % 32)}{chr(0x4E00 + i)}@b.co" for i in range(300)]
    done = spark.createDataFrame([(n,) for n in names], "s string").select(pii._email("k", F.col("s"))).collect()
    assert len({r[0] for r in done}) == len(names)


def test_permutations_are_bijections(spark):
    pairs = spark.range(12 * 7).select(pii.permute_pair("k", "t", F.floor(F.col("id") / 7), F.col("id") % 7, 12, 7).alias("p")).select("p.l", "p.r").collect()
    assert {(r.l, r.r) for r in pairs} == {(a, b) for a in range(12) for b in range(7)}
    strings = spark.range(1000).select(pii.permute_string("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("s")).collect()
    assert {r.s for r in strings} == {f"{i:03d}" for i in range(1000)}
    days = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit(pii.EPOCH).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date("k", F.col("d")).alias("n")).distinct().count() == pii.DAYS


# archives ----------------------------------------------------------------------------


def test_warc(spark):
    trap = "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" + "é" * 40
    rows = [(3, "http://a/", trap), (1, "http://b/\r\nEvil: 1", trap), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "v", trap + "!"), (9, "r", "t" * 100), (8, "r", "t" * 100), (None, "n", "text"), (10, "w", "same"), (10, "w", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1)).repartition(2)
    path = table_path(spark, "warc-test")
    warc.write_archives(df, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows) and all(r.request.record_type == "request" and r.metadata.payload.startswith(b"page-id: ") for r in got)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=i) if len(b) >= 100 else i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", first if first != i else None, b if first == i else b"")] += 1

    def page(r):
        return None if r.metadata.payload == b"page-id: null\r\n" else int(r.metadata.payload.split()[1])

    def refers(r):
        return r.response.refers_to and int(r.response.refers_to.split(":")[3])

    assert Counter((page(r), r.response.payload_bytes, r.response.payload_digest, r.response.record_type, refers(r), bytes(r.response.payload)) for r in got) == want
    empty = table_path(spark, "warc-empty")
    warc.write_archives(df.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


def record(kind, own, to=(), uri="u"):
    return (kind, own, list(to), None, uri, 1, "d", b"")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([record("response", "p", ["q"]), record("request", "q"), record("metadata", "m", ["q"])], {("p", "q", "m")}),
        ([record("response", "p"), record("request", "q", ["p"]), record("metadata", "m", ["q"])], {("p", "q", "m")}),
        ([record("response", "p"), record("request", "q", ["p"]), record("metadata", "m", ["p"]), record("response", "p2"), record("request", "q2", ["p2"])], {("p", "q", "m"), ("p2", "q2", None)}),
        ([record("metadata", "m", ["x", "p"]), record("request", "q", ["x"]), record("response", "p")], {("p", "q", "m")}),
        ([record("request", "q", ["gone"]), record("metadata", "m", ["gone"]), record("response", "p")], {(None, "q", "m"), ("p", None, None)}),
    ],
)
def test_assembly_follows_every_identifier(spark, rows, want):
    df = spark.createDataFrame(rows, warc.RECORD).repartition(2)
    name = lambda m: m.record_id if m else None
    assert {(name(r.response), name(r.request), name(r.metadata)) for r in warc.assemble(df).collect()} == want


def test_assembly_keeps_further_records(spark):
    rows = [record("response", "p"), record("metadata", "m1", ["p"]), record("metadata", "m2", ["p"]), record("request", "q", ["p"])]
    (row,) = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert row.metadata.record_id == "m1" and [m.record_id for m in row.others] == ["m2"]


def test_long_and_repeated_pages(spark, tmp_path):
    long = "<p>" + "word " * 400_000
    rows = [(1, "a", long), (2, "b", long), (None, "c", "x" * 200), (None, "d", "x" * 200), (3, "e", "same"), (3, "f", "other"), (3, "f", "other")]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert Counter((r.response.payload_bytes, r.request.uri, r.metadata.uri, r.response.uri) for r in got) == Counter((len(h), u, u, u) for _, u, h in rows)
    assert [warc_page(r) for r in got if r.response.record_type == "revisit" and r.uri == "b"] == [1]


def warc_page(r):
    return int(re.search(r"page:(-?\d+):", r.response.refers_to)[1])


# tokens and packing ------------------------------------------------------------------


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.token_counts(docs, ["doc_id"], "text", path).collect()
    assert multiset(got) == multiset((i, len(sp.encode(t or ""))) for i, t, *_ in texts())
    assert tokens.token_counts(none, ["doc_id"], "text", path).count() == 0


def test_small_tables_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_TABLE", 10)
    all_texts = [t or "" for _, t, *_ in texts() if len(t or "") < 5000]
    words = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert list(words.encode(t.encode() for t in all_texts)) == [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(all_texts, add_special_tokens=False)]


HOSTILE = [
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "'small 's 't''s ''s (foo)! \"bar's\" it's, Don'T I'LL", "\x01 a\x01b", "e\u0301 \u0301x \u2260 a\u2260 =\u0338",
    "ΑΣ ΣΑΣ. İstanbul ǅ ﬁ", "１２ ²³ Ⅷ x² ㆒", "a\u00a0b c\x1cd\x1ce\x85f", "中文。，好! ไทย ำ हिन्दी", "한글 한ㅏ", "😀👍🏽.. ok…. …x ", "", " \n\t", "foo_bar-baz __init__ $$x%% #1",
    "a.b.c 3.14, 1,000!", "ß ẞ ÀÉ éÀ.", "\ufeffx \u200by", "x<|", "<|endoftext|", "|>", "'S 'Re 'LL'd", "ñ\u0301 o\u0332", "▁ ▁▁x  y", "  two  gaps  ",
]


def test_hostile_texts_have_the_ids_of_the_library(spark):
    words = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(t.encode() for t in HOSTILE)] == [e.ids for e in words.tokenizer.encode_batch(HOSTILE, add_special_tokens=False)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(HOSTILE)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"], "text", path).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(HOSTILE)}


def test_counts_do_not_depend_on_chunks(docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = multiset(tokens.token_counts(docs, ["doc_id", "source"], "text", path).collect())
    monkeypatch.setattr(tokens, "COUNT_BYTES", 1000)
    assert multiset(tokens.token_counts(docs, ["doc_id", "source"], "text", path).collect()) == whole


def test_a_pre_token_is_counted_once(docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    kept = {}
    write = tokens.write_table
    monkeypatch.setattr(tokens, "write_table", lambda df, name: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(tokens, "COUNT_BYTES", 20_000)
    tokens.token_counts(docs, ["doc_id"], "text", path).count()
    shards = defaultdict(set)
    for r in kept["pre-tokens"].where("shard IS NOT NULL").collect():
        for w in tokens._unpacked(r.words).decode().split(" "):
            shards[w].add(r.shard)
    assert set(shards) >= {"quick", "w17x3"} and all(len(s) == 1 for s in shards.values()) and len(set.union(*shards.values())) > 5


def test_count_query_columns(spark):
    rows = queries.op3_token_counts(spark, "/root/testdata/sf0.001").collect()
    size = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.n_bytes == size[r.doc_id] and r.over_limit == (r.n_tokens > 4096) for r in rows) and len(rows) == len(size)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in texts():
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 2048
    assert packing.pack(none, path).count() == 0


def best_fit(counts):
    """Sequences that best-fit decreasing needs, a piece at a time."""
    capacity, rooms = len(counts) - 1, []
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits)[1]] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def solved(h, capacity):
    found = packing.solve(h, capacity)
    used = Counter()
    for config, times in found.plan:
        assert sum(k * a for k, a in config.items()) <= capacity and times > 0
        used.update({k: a * times for k, a in config.items()})
    assert used == Counter(h)
    return sum(t for _, t in found.plan), found


def test_plan_covers_every_histogram():
    rng = np.random.default_rng(0)
    for _ in range(6):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 12), rng.integers(1, 60, 12), strict=True)}
        n = np.bincount(list(h), weights=list(h.values()), minlength=101).astype(int)
        total, found = solved(h, 100)
        assert found.bound <= total <= best_fit(n) and found.bound >= -(-sum(k * a for k, a in h.items()) // 100)
    assert packing.solve({}, 100) == ([], 0, 0)


@pytest.mark.parametrize(
    ("h", "capacity", "best"),
    [({700: 30, 690: 40, 650: 35, 1400: 20, 1000: 15}, 2048, 63), ({6: 2, 5: 2, 4: 2, 3: 4, 2: 4}, 25, 2), (dict(Counter(np.random.default_rng(1).integers(300, 900, 300).tolist())), 2048, None)],
)
def test_program_beats_best_fit(h, capacity, best):
    total, found = solved(h, capacity)
    n = np.zeros(capacity + 1, dtype=int)
    n[list(h)] = list(h.values())
    assert total <= (best or found.bound + 1) and total <= best_fit(n)
    if capacity == 2048:
        assert total < best_fit(n)


def test_rounding_places_sequences_of_the_small_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", path, 2048, 0)
    h = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total, found = solved(h, 2048)
    assert found.rounded > 0 and found.bound <= total <= found.bound + 1


# mixing ------------------------------------------------------------------------------


def drawn(rate, seed, key):
    def inv(u, lam):
        p = c = math.exp(-lam)
        k = 0
        while u > c and k < mixing.TERMS:
            k += 1
            p *= lam / k
            c += p
        return k

    def u(*parts):
        return (int(hashlib.md5("|".join([str(seed), *parts]).encode()).hexdigest()[:12], 16) + 0.5) / 2**48

    whole = int(rate // mixing.CHUNK)
    return inv(u(key), rate - whole * mixing.CHUNK) + sum(inv(u(key, str(i + 1)), mixing.CHUNK) for i in range(whole))


@pytest.mark.parametrize("options", [{}, {"targets": {"s0": 3, "s1": 1}, "total": 2000.0, "seed": 3}])
def test_mixing(docs, none, options):
    got = mixing.replicate(docs.drop("rate"), **options).collect()
    n = Counter(s for _, _, s, *_ in texts())
    weight = {s: options["targets"].get(s, 0) if "targets" in options else k**0.5 for s, k in n.items()}
    total = options.get("total", sum(n.values()))
    want = Counter()
    for i, _, s, *_ in texts():
        rate = weight[s] / sum(weight.values()) * total / n[s]
        want.update((i, c) for c in range(drawn(rate, options.get("seed", 17), "" if i is None else str(i))))
    assert Counter((r.doc_id, r.copy) for r in got) == want
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys)
    assert mixing.replicate_documents(docs).columns == docs.columns and mixing.replicate(none).count() == 0


def test_mixing_under_clashing_names(docs):
    named = docs.withColumns({"copy": F.lit("mine"), "shuffle_key": F.lit("own")})
    kept = mixing.replicate_documents(named)
    assert kept.columns == named.columns and {(r["copy"], r.shuffle_key, r.rate) for r in kept.collect()} == {("mine", "own", "own")}
    assert dict(mixing.replicate(named).dtypes)["copy"] == "bigint"


def test_high_rates_are_sums_of_parts(spark):
    rows = [(i, "rare" if i < 3 else "common") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.replicate(df, targets={"rare": 5, "common": 1}, total=200.0).collect())
    assert {i: got[i] for i in range(3)} == {i: drawn(200 * 5 / 6 / 3, 17, str(i)) for i in range(3)}


# similarity --------------------------------------------------------------------------


def shingle_set(t, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def least_reachable(nodes, links):
    c = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(c[a], c[b])
            if c[a] != m or c[b] != m:
                c[a] = c[b] = m
                changed = True
    return c


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, none, k, percent):
    rng = np.random.default_rng(k)
    rows = [(i, t) for i, t, *_ in texts() if len(t or "") < 100_000]
    passage = [f"p{i}" for i in range(60)]
    for g in range(12):  # groups of edited copies, and a passage that many share
        base = [f"g{g}w{rng.integers(400)}" for _ in range(120)]
        for c in range(6):
            w = list(base)
            for _ in range(c * 2):
                w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
            rows.append((1000 + 10 * g + c, " ".join(w + (passage if g % 2 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).repartition(3)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t, k))
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a, b in combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = least_reachable(ids, links)
    got = jaccard.link_components(df, k, percent).collect()
    assert multiset(got) == multiset((i, len(sets[i]), want.get(i)) for i, _ in rows)
    if k == 5:
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i is None or want[i] == i)
        assert jaccard.link_components(none).count() == 0


def pairs_of(batches):
    out = [dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return Counter((r["x"], r["y"], r["times"]) for r in out if r["shingle"] is None), [tuple(r[c] for c in jaccard._ROW) for r in out if r["shingle"] is not None]


def row_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(jaccard._ROW))


def test_merge_over_batch_borders(monkeypatch):
    rows = [(1, 5, 9, 0, 5), (1, 6, 9, 0, 6), (1, 7, 9, 0, 7), (2, 5, 9, 1, 5), (3, 6, 9, 1, 6), (3, 7, 9, 1, 7)]
    for cut in range(1, 6):
        found, long = pairs_of(jaccard._lists(80)(iter([row_batch(rows[:cut]), row_batch(rows[cut:])])))
        assert found == {(5, 6, 2): 1, (5, 7, 2): 1, (6, 7, 2): 2} and not long
    monkeypatch.setattr(jaccard, "LIST", 2)
    for cut in range(1, 6):
        found, long = pairs_of(jaccard._lists(80)(iter([row_batch(rows[:cut]), row_batch(rows[cut:])])))
        assert found == {(6, 7, 2): 1} and sorted(long) == rows[:3]


def test_long_lists_give_what_short_ones_give(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, i, int(rng.integers(8, 14)), int(rng.integers(0, 4)), i if i % 3 else 0) for s in range(4) for i in range(30)]
    want = Counter()
    for s in range(4):
        own = np.array([r[1:] for r in rows if r[0] == s]).T
        want.update(tuple(int(v) for v in p) for c in jaccard.compare(own, own, 80, True) for p in c.T)
    monkeypatch.setattr(jaccard, "LIST", 4)
    df = spark.createDataFrame(rows, "shingle long, id long, n long, pos long, comp long").repartition(3)
    assert multiset(jaccard.long_lists(df, 80).collect()) == want and want


def test_one_shingle_list_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 16)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, common if i % 2 else f"{common} x{i}") for i in range(300)] + [(1000 + i, f"{common} " + " ".join(f"y{i}z{j}" for j in range(i % 9 + 1))) for i in range(60)]
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = least_reachable(list(sets), [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, want[i]) for i in sets}


def test_long_texts_are_joined_whole(spark):
    rows = [(7, LONG), (8, LONG + " end"), (9, LONG[: len(LONG) // 2]), (10, "x" * 300_000), (11, "x" * 300_000)]
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(shingle_set(t, 5)), {8: 7, 11: 10}.get(i, i)) for i, t in rows}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(6)
    edges = [(int(x), int(x + d)) for x, d in zip(rng.integers(0, 400, 500), rng.integers(0, 12, 500), strict=True)] + [(900, 900), (7, 7), (1, 600), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()}
    real = [(x, y) for x, y in edges if x is not None and x != y]
    nodes = {x for e in real for x in e}
    assert got == {x: c for x, c in least_reachable(list(nodes), real).items()}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(40, 16))
    for i in range(300):
        v = base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.12)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], None), (403, None, 1), (404, [0.0] * 16, 1), (405, [float("nan")] + [1.0] * 15, 1), (406, [None] + [1.0] * 15, 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("own"))
    ok = [(n, i, np.array(v, dtype=np.float32).astype(float), c) for n, (i, v, c) in enumerate(rows) if c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, degree = [], Counter()
    for (n, i, v, c), (m, j, w, d) in combinations(ok, 2):
        if c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
            links.append((i, j))
            degree[n] += 1
            degree[m] += 1
    want = least_reachable([i for i, *_ in rows], links)
    got = embeddings.near_duplicates(df)
    assert multiset(got.collect()) == multiset((i, degree[n], want[i], want[i] == i) for n, (i, *_) in enumerate(rows))
    assert embeddings.recall(df, got.where("vec_id < 400"), every=50) >= 0.9
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def true_links(x, labels, cosine=0.93):
    """Links per row and component, by brute force in blocks."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = np.zeros((len(x), len(x)), dtype=bool)
    for s in range(0, len(x), 500):
        hit[s : s + 500] = (u[s : s + 500] @ u.T >= cosine) & (labels[s : s + 500, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], len(x)).min(1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return hit.sum(1), root
        root = new


def clustered(rng, n, dims, rank, near, cosine=0.935):
    """Vectors of a subspace of ``rank`` dimensions; each ``near``-th has a partner just above the threshold inside it."""
    base = rng.normal(size=(rank, dims))
    y = rng.normal(size=(n, rank))
    x = y @ base
    for i in range(0, n - 1, near):
        side = rng.normal(size=rank) @ base
        u = x[i] / np.linalg.norm(x[i])
        side -= (side @ u) * u
        x[i + 1] = cosine * u + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    return x


def as_vectors(spark, x, labels):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize(("dims", "rank"), [(384, 6), (256, 16), (32, 32)])
def test_recall_does_not_depend_on_the_spread(spark, monkeypatch, dims, rank):
    monkeypatch.setattr(embeddings, "CELL", 16)  # many cells
    rng = np.random.default_rng(rank)
    x = clustered(rng, 3000, dims, rank, 4)
    df = as_vectors(spark, x, np.zeros(len(x), dtype=int))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    degree, _ = true_links(x, np.zeros(len(x)))
    found = sum(min(got[i].n_links, int(degree[i])) for i in range(len(x)))
    assert all(got[i].n_links <= degree[i] for i in range(len(x))) and found >= 0.99 * degree.sum()


def test_target_of_one_is_exact_and_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "SLICE", 30)
    monkeypatch.setattr(embeddings, "VISITORS", 50)
    rng = np.random.default_rng(8)
    x = clustered(rng, 900, 24, 5, 3)
    labels = rng.integers(0, 2, len(x))
    degree, root = true_links(x, labels)
    got = embeddings.near_duplicates(as_vectors(spark, x, labels), target_recall=1).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, int(d), int(c)) for i, (d, c) in enumerate(zip(degree, root, strict=True))}


def test_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SLICE", 100)
    rng = np.random.default_rng(9)
    x = rng.normal(size=64)[None, :] + rng.normal(size=(1200, 64)) * 0.05
    got = embeddings.near_duplicates(as_vectors(spark, x, np.zeros(len(x), dtype=int))).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1199, 0)}


def test_multi_sequence_is_sorted():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    cost = [a[i] + b[j] for i, j in embeddings.multi_sequence(a, b, 0.5)]
    assert cost == sorted(cost) and len(cost) == sum(x + y <= 0.5 for x in a for y in b)


# chat --------------------------------------------------------------------------------


def test_chat(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "hi <|end|>\n"), (1, 2, "assistant", None), (1, 2, "assistant", "&lt; <b>"), (2, 0, "assistant", "x " * 3000), (2, 1, "user", "y"), (3, 0, "system", "alone"), (None, 0, "user", "q"), (None, 1, None, "r"), (4, 0, "assis|>tant", "a"), (5, 7, "assistant", "t"), (5, 7, "assistant", "t")]
    rows += [(6, i, ["user", "assistant"][i % 2], " ".join(["word"] * int(rng.integers(1, 60))) + " <|user|>") for i in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(0)).repartition(3)
    windows = chat.format_windows(df, budget=200, history=40)
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n, r or "", t or ""))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = windows.collect()
    assert all(w.n_tokens <= 200 or w.formatted.count("<|end|>") == 1 for w in shown)
    assert sum(w.n_context > 0 for w in shown if w.conv_id == 6) > 5
    assert chat.format_windows(df.limit(0)).count() == 0


def greedy(turns, budget, history):
    """Windows as (first, last) of the turns' tokens; turns are (tokens, is_system)."""
    system = turns[0][0] if turns and turns[0][1] else 0
    out, used = [], 0
    for i, (n, is_system) in enumerate(turns):
        room = max(1, budget - system - (0 if len(out) <= 1 else history))
        if not out or (not is_system and used and used + n > room):
            out.append([i, i])
            used = 0
        out[-1][1] = i
        used += 0 if is_system else n
    return out


def test_windows_are_filled_turn_by_turn(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes = {1: [30] * 60, 2: [30] * 60 + [1200] + [5] * 4, 3: rng.integers(1, 90, 80).tolist(), 4: [2000], 5: [1] * 400}
    rows = [(c, i, ["user", "assistant"][i % 2], " ".join(["w"] * n)) for c, ns in sizes.items() for i, n in enumerate(ns)]
    rows += [(6, 0, "system", "be kind " * 40), *((6, i, "user", "w " * 50) for i in range(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for w in chat.format_windows(df, budget=1024, history=192).collect():
        found[w.conv_id].append(w.first_turn)
    by = defaultdict(list)
    for c, i, r, t in sorted(rows):
        by[c].append((len(t.split()) + chat.MARKS, i == 0 and r == "system"))
    assert {c: sorted(f) for c, f in found.items()} == {c: [a + 1 for a, _ in greedy(t, 1024, 192)] for c, t in by.items()}
    assert len(found[2]) <= len(found[1]) + 2  # one long turn moves no other border far
    monkeypatch.setattr(chat, "STRETCH", 1)
    windows = chat.format_windows(df, budget=1024, history=192)
    assert all(w.n_tokens <= 1024 or w.formatted.count("<|end|>") == 1 for w in windows.collect())
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for c in by:
        loss = "".join(t for k, _, r, t in sorted(rows) if k == c and r == "assistant")
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].n_turns == len(by[c])


# language model ----------------------------------------------------------------------


def brute_ctw(train, text):
    """Recursive context-tree weighting with frozen counts, straight from the definition."""
    counts, children, memo = {}, defaultdict(set), {}

    def steps(t):
        b = bytes(ctw.DEPTH) + t + b"\xff"
        for i in range(ctw.DEPTH, len(b)):
            node = 1
            for j in range(7, -1, -1):
                bit = b[i] >> j & 1
                yield b[i - ctw.DEPTH : i], node, bit
                node = 2 * node + bit

    for t in train:
        for context, node, bit in steps(t):
            for d in range(ctw.DEPTH + 1):
                counts.setdefault((node, context[ctw.DEPTH - d :]), [0, 0])[bit] += 1
                if d:
                    children[node, context[ctw.DEPTH - d + 1 :]].add(context[ctw.DEPTH - d :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node, s):
        if (node, s) not in memo:
            e = kt(*counts.get((node, s), (0, 0)))
            below = sum(weighted(node, c) for c in children.get((node, s), ()))
            memo[node, s] = e if len(s) == ctw.DEPTH else float(np.logaddexp(e, below)) - math.log(2)
        return memo[node, s]

    total = 0.0
    for context, node, bit in steps(text):
        p = 0.5
        for d in range(ctw.DEPTH, -1, -1):
            s = context[ctw.DEPTH - d :]
            a = counts.get((node, s), (0, 0))
            own = 1.0 if d == ctw.DEPTH else math.exp(kt(*a) - math.log(2) - weighted(node, s))
            p = own * (a[bit] + 0.5) / (sum(a) + 1) + (1 - own) * p
        total += math.log10(p)
    return total


def test_context_tree_weighting(spark, none, monkeypatch):
    rows = [(i, t) for i, t, *_ in texts() if len(t or "") < 600] + [(30 + i, " ".join(BASE[i % 9 :])) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 900)
    got = ctw.score_documents(df).collect()

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    def tok(t):
        return [*t.lower().split(), None]

    train = [(t or "").encode() for i, t in rows if not held(i)]
    c = Counter(x for t in train for x in tok(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        want[i] = (held(i), len(tok(b)), sum(c[x] > 0 for x in tok(b)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(b)), brute_ctw(train, b))
    assert len(got) == len(rows) and any(held(i) for i, _ in rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], rel=1e-6, abs=1e-6)
    assert ctw.score_documents(none).count() == 0


def test_language_model_on_long_texts_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 2000)
    long = " ".join(f"w{i % 60} x{i % 7}" for i in range(4000))
    rows = [(5, long)] + [(5, " ".join(BASE[i % 5 :])) for i in range(40)] + [(None, "a b c")] * 20
    got = ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t)) for i, t in rows)
    by = {}
    for r in got:
        assert by.setdefault((r.doc_id, r.n_bytes), r.score) == pytest.approx(r.score)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)
    assert next(r for r in got if r.n_bytes == len(long)).bits_per_byte < 2  # it repeats itself


def test_contexts_are_never_parted(monkeypatch):
    monkeypatch.setattr(ctw, "CONTEXT_ROWS", 5)
    code = np.array([(c << 8) + x for c in (1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4) for x in (7,)], dtype=np.int64) + np.arange(12)
    code = (code >> 8 << 8) + np.arange(12)
    batches = [pa.RecordBatch.from_arrays([pa.array(code[i : i + 2]), pa.array(np.ones(2, np.int64)[: len(code[i : i + 2])])], names=["gram", "n"]) for i in range(0, 12, 2)]
    parts = list(ctw.whole_contexts(iter(batches)))
    assert np.concatenate([c for c, _ in parts]).tolist() == code.tolist() and len(parts) > 1
    seen = [set((c >> 8 & 0xFFFF).tolist()) for c, _ in parts]
    assert sum(map(len, seen)) == len(set.union(*seen))
