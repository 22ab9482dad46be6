r"""Jaccard self-join of documents on word n-grams by T-occurrence search (DivideSkip).

A document is the set of its distinct ``k``-word shingles (64-bit hashes of lower-cased
words).  Documents of sizes n and m link when their overlap reaches ``percent`` of the
union, so any partner shares at least T = ceil(percent * n / 100) of a document's n
inverted lists.  DivideSkip parts these lists: the T - ``MERGE`` longest are *long* and never
scanned; a partner must then occur ``MERGE`` times in the others, the *short* lists, which are
merged in sorted order while occurrences are counted.  For the candidates that reach the
count, the remaining lists are probed by binary search in the partner's sorted set, and
pairs that reach the overlap stay.

Both sides of the join index their short lists only.  That loses nothing: of the shingles
that two partners share, in the common order of lists, the first ``MERGE`` are in the short
lists of both (each has T - ``MERGE`` others at the most).

List lengths come from a table of hashed counters over all documents (``2 **
sketch_bits`` of them, so its size is fixed); any counts give a correct result, better
counts give shorter lists.  In a short list, sizes and positions rule out most pairs
before they are written: the first ``MERGE`` lists that two partners share always keep them.

A list of more than ``LIST`` documents is not merged where it is found.  Its rows are sorted
by component and size into blocks of ``LIST`` rows, and two blocks are compared only if they
hold more than one component and sizes that can link; so a list that a large group of
near copies fills costs its length, and no task holds more than two blocks.

Groups of copies stay cheap without losing a component:

* documents of equal sets become one class (a digest of the set), represented by the
  smallest id;
* classes that share a minimum under one of ``MINIMA`` hash permutations are compared
  with the smallest id of that group only (a star, not all pairs), and verified links
  join them to components;
* the merge then skips pairs that are already in one component: a further link between
  them changes no component.  Links are therefore not counted.

Defined results: null or empty texts have no shingles and link with nothing; fewer than
``k`` words are one shingle; texts are never cut, however long; repeated rows are of one
class; ids are integers; rows with a null id get a null component and take no part; other columns of the
table, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.graph import components
from catalith.llm.names import sheltered
from catalith.operators.ranking import running_sums
from catalith.plans.storage import checkpoint, write_table

MINIMA = 3
#: Short lists that two partners must share at least (fewer where T is smaller).
MERGE = 2
#: Rows of a list that are compared in one place.
LIST = 4096
#: Ids (8 bytes each) up to which a list of wanted documents is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Odd multipliers and offsets of the mixing steps and permutations (fixed values).
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PERMUTE = [(np.uint64(0x9FB21C651E98DF25), np.uint64(11)), (np.uint64(0xA0761D6478BD642F), np.uint64(23)), (np.uint64(0xE7037ED1A0B428DB), np.uint64(37))]


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), dtype=np.uint64)
    for i in range(min(k, len(w))):
        h = ((h ^ (h >> np.uint64(29))) * _M1) + w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    h.sort()
    keep = np.empty(len(h), dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap o with 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))


def profile(docs: DataFrame, k: int, sketch_bits: int) -> DataFrame:
    """Per document: id, n, digest of its set, minima.  Rows with ``chunk`` hold a task's counters instead."""
    size, mask = 1 << sketch_bits, np.uint64((1 << sketch_bits) - 1)
    step = min(size, 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int32)
        for b in batches:
            n, sig, minima, pending = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                if len(s):
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    minima.append([int(((s ^ (s >> r)) * m).min().astype(np.int64)) for m, r in _PERMUTE])
                    pending.append(s & mask)
                else:
                    sig.append(None)
                    minima.append([])
            if pending:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(minima, pa.list_(pa.int64())), pa.nulls(len(n), pa.int32())],
                names=["id", "n", "sig", "minima", "chunk"],
            )
        at = [c for c in range(size // step) if counts[c * step : (c + 1) * step].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.int64()), pa.array([0] * len(at), pa.int64()), pa.array([counts[c * step : (c + 1) * step].tobytes() for c in at], pa.binary()), pa.array([[]] * len(at), pa.list_(pa.int64())), pa.array(at, pa.int32())],
            names=["id", "n", "sig", "minima", "chunk"],
        )

    return docs.mapInArrow(run, "id long, n long, sig binary, minima array<long>, chunk int")


def list_lengths(rows: DataFrame, sketch_bits: int) -> np.ndarray:
    """The tasks' counters summed; the result has ``2 ** sketch_bits`` numbers whatever the input."""
    step = min(1 << sketch_bits, 1 << 14)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, s in zip(b.column("chunk").to_pylist(), b.column("sig"), strict=True):
                part = np.frombuffer(s.as_py(), dtype=np.int32)
                total[c] = total[c] + part if c in total else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "sum"])

    summed = rows.where("chunk IS NOT NULL").select("chunk", "sig").repartition("chunk").mapInArrow(add, "chunk int, sum binary")
    out = np.zeros(1 << sketch_bits, dtype=np.int64)
    for r in summed.collect():
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["sum"], dtype=np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids`` (column ``id``, a checkpointed frame)."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (x, y), those whose sets reach the overlap."""
    ids = checkpoint(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingles(t.as_py(), k).tobytes() for t in part.column("text")], pa.binary())], names=["id", "set"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for sx, sy in zip(b.column("sx"), b.column("sy"), strict=True):
                a, c = np.frombuffer(sx.as_buffer(), dtype=np.uint64), np.frombuffer(sy.as_buffer(), dtype=np.uint64)
                if len(a) > len(c):
                    a, c = c, a
                at = np.searchsorted(c, a)
                at[at == len(c)] = 0
                good.append(bool(int((c[at] == a).sum()) >= least_overlap(len(a), len(c), percent)))
            yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(good)), b.column("y").filter(pa.array(good))], names=["x", "y"])

    kept = write_table(_wanted(docs, ids).mapInArrow(sets, "id long, set binary").dropDuplicates(["id"]), "sets")
    half = pairs.join(kept.select(F.col("id").alias("x"), F.col("set").alias("sx")), "x")
    both = half.join(kept.select(F.col("id").alias("y"), F.col("set").alias("sy")), "y")
    return both.select("x", "y", "sx", "sy").mapInArrow(probe, "x long, y long")


def star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Each class with the smallest class that shares one of its minima, where sizes allow a link."""
    keyed = checkpoint(classes.select("rep", "n", F.posexplode("minima").alias("i", "minimum")))
    leader = keyed.groupBy("i", "minimum").agg(F.min(F.struct("rep", "n")).alias("_l"), F.count("*").alias("_c")).where("_c > 1")
    leader = checkpoint(leader.select("i", "minimum", F.col("_l.rep").alias("x"), F.col("_l.n").alias("m")))
    met = keyed.join(leader, ["i", "minimum"]).where("rep <> x").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return met.select("x", F.col("rep").alias("y")).distinct()


def least_shared(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """T: lists of a set of ``n`` that any partner shares."""
    return -(-percent * n // 100)


def compare(a: np.ndarray, b: np.ndarray, percent: int, ordered: bool) -> list[np.ndarray]:
    """Candidates (x, y, times needed) between rows (id, n, pos, comp) of one list; ``ordered``: x < y only."""
    out = []
    ids, n, pos, comp = b
    for s in range(0, a.shape[1], 256):
        i, m, at, of = (v[s : s + 256, None] for v in a)
        times = np.minimum(MERGE, np.minimum(least_shared(m, percent), least_shared(n[None, :], percent)))
        ok = (np.minimum(m - at, n - pos) >= least_overlap(m, n[None, :], percent) - times + 1) & (of != comp)
        if ordered:
            ok &= i < ids
        x, y = ok.nonzero()
        out.append(np.stack([np.minimum(i[x, 0], ids[y]), np.maximum(i[x, 0], ids[y]), times[x, y]]))
    return out


_ROW = ("shingle", "id", "n", "pos", "comp")
#: Candidates (x, y, times) with a null shingle, and rows of lists that were too long.
_MERGED = "x long, y long, times long, shingle long, id long, n long, pos long, comp long"


def _lists(percent: int):
    """Merges sorted short lists (shingle, id, n, pos, comp) to candidate pairs of different components."""

    def batch(found: list[np.ndarray], long: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        rows = np.concatenate(long, axis=1) if long else np.empty((5, 0), np.int64)
        column = lambda v, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(v, pa.int64()), pa.nulls(after, pa.int64())])
        return pa.RecordBatch.from_arrays(
            [*(column(v, 0, rows.shape[1]) for v in pairs), *(column(v, pairs.shape[1], 0) for v in rows)],
            names=["x", "y", "times", *_ROW],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)  # rows of the list that may go on in the next batch
        passed: int | None = None  # the list whose rows are passed on
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy().astype(np.int64) for c in _ROW])], axis=1)
            begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            end = np.r_[begin[1:], rows.shape[1]]
            mixed = np.minimum.reduceat(rows[4], begin) != np.maximum.reduceat(rows[4], begin)
            found, long = [], []
            for i in np.flatnonzero((mixed & (end - begin > 1)) | (end - begin > LIST) | (rows[0, begin] == passed)):
                own, last = rows[:, begin[i] : end[i]], i == len(begin) - 1
                if own.shape[1] > LIST or own[0, 0] == passed:
                    long.append(own)
                    passed = int(own[0, 0])
                elif not last and mixed[i]:
                    found += compare(own[1:], own[1:], percent, True)
            held = rows[:, begin[-1] :] if rows[0, -1] != passed else np.empty((5, 0), np.int64)
            if found or long:
                yield batch(found, long)
        if held.shape[1] > 1 and (found := compare(held[1:], held[1:], percent, True)):
            yield batch(found, [])

    return merge


def short_lists(docs: DataFrame, known: DataFrame, lengths: np.ndarray, k: int, percent: int) -> DataFrame:
    """Rows (shingle, id, n, pos, comp): each class's n - T + ``MERGE`` shingles with the shortest lists."""
    mask = np.uint64(len(lengths) - 1)
    table = docs.sparkSession.sparkContext.broadcast(lengths)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = table.value
        for b in batches:
            n, short = [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                least = least_shared(len(s), percent)
                p = len(s) - least + min(MERGE, least)
                order = np.argsort(length[(s & mask).astype(np.int64)], kind="stable")[:p] if len(s) else []
                short.append(s[order].astype(np.int64))
            offsets = np.r_[0, np.cumsum([len(s) for s in short])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(short) if short else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), lists], names=["id", "n", "short"])

    ranked = docs.mapInArrow(rank, "id long, n long, short array<long>").join(known, "id")
    return ranked.select(F.posexplode("short").alias("pos", "shingle"), "id", "n", "comp").select("shingle", "id", "n", F.col("pos").cast("long").alias("pos"), "comp")


def long_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y, times) from lists (shingle, id, n, pos, comp) of any length, in blocks."""
    ranked = running_sums(rows.select(*_ROW), ["shingle"], [F.asc("comp"), F.asc("n"), F.asc("id")], {"rank": F.lit(1).cast("long")})
    blocked = write_table(ranked.withColumn("block", F.floor(F.col("rank") / LIST)).drop("rank"), "long-lists")
    extent = blocked.groupBy("shingle", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    one, two = (extent.select(F.col("shingle").alias("shingle" if side == "a" else "_s"), *(F.col(c).alias(f"{side}_{c}") for c in ("block", "c0", "c1", "n0", "n1"))) for side in "ab")
    met = one.join(two, (F.col("shingle") == F.col("_s")) & (F.col("a_block") <= F.col("b_block")))
    several = F.least("a_c0", "b_c0") < F.greatest("a_c1", "b_c1")
    fits = (100 * F.col("a_n1") >= percent * F.col("b_n0")) & (100 * F.col("b_n1") >= percent * F.col("a_n0"))
    met = checkpoint(met.where(several & fits).select("shingle", "a_block", "b_block"))
    sides = [
        blocked.join(met.withColumnRenamed(f"{side}_block", "block"), ["shingle", "block"]).select(*_ROW, F.col("block").alias(f"{side}_block"), f"{other}_block", F.lit(side == "a").alias("first"))
        for side, other in ("ab", "ba")
    ]

    def both(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _ROW[1:]])
        first = table.column("first").to_numpy()
        same = table.column("a_block")[0].as_py() == table.column("b_block")[0].as_py()
        found = compare(rows[:, first], rows[:, ~first], percent, same)
        cols = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("x", "y", "times"), cols, strict=True)})

    return sides[0].unionByName(sides[1]).groupBy("shingle", "a_block", "b_block").applyInArrow(both, "x long, y long, times long")


def link_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", sketch_bits: int = 20) -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id (smallest id reachable through links)."""
    docs = _texts(df, id_col, text)
    rows = write_table(profile(docs, k, sketch_bits), "profiles")
    plain = rows.where("chunk IS NULL").select("id", "n", "sig", "minima")
    sized = plain.where("id IS NOT NULL AND n > 0")
    classes = write_table(sized.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("minima").alias("minima")), "classes")

    stars = checkpoint(verify(docs, checkpoint(star_pairs(classes, percent)), k, percent))
    joined = components(stars, "x", "y")
    known = classes.select(F.col("rep").alias("id")).join(joined, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("comp"))
    known = write_table(known, "known")

    lists = short_lists(docs, known, list_lengths(rows, sketch_bits), k, percent)
    merged = write_table(lists.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_lists(percent), _MERGED), "merged")
    occurred = merged.where("shingle IS NULL").select("x", "y", "times")
    long = merged.where("shingle IS NOT NULL")
    if not long.isEmpty():
        occurred = occurred.unionByName(long_lists(long, percent))
    counted = occurred.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("times").alias("times"))
    candidates = checkpoint(counted.where("n >= times").select("x", "y"))
    links = stars.unionByName(verify(docs, candidates, k, percent))

    groups = components(links, "x", "y")
    named = classes.select("sig", "rep").join(groups, F.col("rep") == F.col("node"), "left").select(F.col("sig").alias("_sig"), F.coalesce("component", "rep").alias("_c"))
    named = write_table(named, "named")
    out = plain.join(named, plain["sig"] == named["_sig"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_c", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those that another document of their group stands for.

    The smallest id of each group stays.  Rows that share an id stay or go together.
    """
    linked = link_components(df, k, percent, id_col, text)
    gone = checkpoint(linked.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct())
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = F.broadcast(gone) if small else gone
    return sheltered(df, lambda d, name: d.join(gone, F.col(name(id_col)).cast("long") == F.col("_gone"), "left_anti"))
