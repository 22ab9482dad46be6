"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut in halves; each half has its own codebook (k-means on a bounded
sample, ``SAMPLE`` rows), and the pairs of code words form a product grid of cells.  The
number of code words follows the size of a label: about ``CELL`` vectors a cell, in powers
of two up to ``MOST_CODEWORDS`` a half.  Every vector lies in one cell; a vector visits
cells in the order of the multi-sequence algorithm.  The cost of a cell is how far, beyond
its own cell, a vector would have to move to enter it (distance to the bisecting planes of
the two halves), and the traversal ends where a partner at the largest linked distance
would be found with the target probability (``measured_limit``).  Candidates are verified
by exact cosine in double precision.

A partner at distance r can't lie in a cell that costs more than r * r, whatever the data:
``target_recall=1`` traverses up to that cost and is exact.

Equal vectors (same label) are merged before and expanded after, so copies cost nothing.
A cell's members and its visitors are cut into slices, and each pair of slices is one block
of a matrix product of bounded size; blocks return counts and edges of a spanning forest,
never pairs.  A link is counted for both ends although only one of them may visit the
other's cell.

Recall is measured, not assumed: ``recall`` compares a query set with brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows without a label, link with nothing; repeated rows are links of each other; lengths
that differ never link; ids are integers; a null id is left out of links; other columns of the table, whatever
their names, are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.graph import components
from catalith.plans.storage import checkpoint, write_table

SAMPLE = 20_000
#: Sampled vectors whose surroundings set the traversal's end.
PROBES = 2_000
#: Vectors of a label a cell on average, and code words a half at the most: enough for 500 million vectors of a
#: label, and as many as SAMPLE can place; with more vectors cells grow, results don't change.
CELL, MOST_CODEWORDS = 128, 2048
#: Distances of vectors to code words held at a time.
DISTANCES = 4_000_000
#: Members and visitors of a cell in one block.
SLICE, VISITORS = 1024, 4096
#: Labels, or cells of more than one slice, up to which their table is broadcast (some ten bytes a row).
BROADCAST_ROWS = 200_000
#: Code words of the two halves; all labels share them.
Codebooks = tuple[np.ndarray, np.ndarray]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        for j in range(len(centres)):
            if (own := near == j).any():
                centres[j] = x[own].mean(0)
    return centres


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their unit vectors in double precision."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        own = vectors if len(at) == len(size) else vectors.take(pa.array(at))
        x = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        x = x / np.abs(x).max(1)[:, None]  # neither overflow nor underflow in the squares
        yield at, x / np.linalg.norm(x, axis=1)[:, None]


def fit(sample: dict[int, np.ndarray], codewords: set[int]) -> dict[tuple[int, int], Codebooks]:
    """Codebooks by (vector length, code words)."""
    return {(n, k): (kmeans(x[:, : n // 2], k), kmeans(x[:, n // 2 :], k, seed=6)) for n, x in sample.items() if n > 1 for k in codewords if k > 1}


def _margins(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and its distance to the plane between home and each other cell."""
    d2 = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    home = d2.argmin(1)
    gap = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 0))[home]
    m = (d2 - d2[np.arange(len(x)), home][:, None]) / np.where(gap > 0, 2 * gap, np.inf)
    return home, np.maximum(m, 0)


def costs(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of unit vectors (number = i * codewords + j) and the squared margins of the two halves."""
    half = x.shape[1] // 2
    (i, a), (j, b) = _margins(x[:, :half], books[0]), _margins(x[:, half:], books[1])
    return i * len(books[1]) + j, a**2, b**2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) by rising a[i] + b[j] while that is at most ``limit`` (Babenko and Lempitsky's traversal)."""
    oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = np.sort(a).tolist(), np.sort(b).tolist()
    heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap:
        c, i, j = heapq.heappop(heap)
        if c > limit and out:
            break
        out.append((oa[i], ob[j]))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[n[0]] + b[n[1]], *n))
    return out


def visit(x: np.ndarray, books: Codebooks, limit: float) -> list[list[int]]:
    """Visited cells of each unit vector, home first."""
    k = len(books[1])
    if len(x) > (step := max(1, DISTANCES // k)):
        return [cells for s in range(0, len(x), step) for cells in visit(x[s : s + step], books, limit)]
    home, a, b = costs(x, books)
    return [[h, *(c for i, j in multi_sequence(p, q, limit) if (c := i * k + j) != h)] for h, p, q in zip(home.tolist(), a, b, strict=True)]


def partners(x: np.ndarray, cosine: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of ``x`` and for each a unit vector at ``cosine`` from it, towards its nearest other row."""
    rng = np.random.default_rng(7)
    q = x[rng.choice(len(x), size=min(probes, len(x)), replace=False)]
    to = np.empty_like(q)
    for s in range(0, len(q), 256):
        dot = q[s : s + 256] @ x.T
        dot[dot > 1 - 1e-9] = -2  # itself and equal vectors
        to[s : s + 256] = x[dot.argmax(1)]
    side = to - (to * q).sum(1)[:, None] * q
    length = np.linalg.norm(side, axis=1)
    good = length > 1e-6
    return q[good], cosine * q[good] + math.sqrt(max(0.0, 1 - cosine**2)) * side[good] / length[good][:, None]


def measured_limit(x: np.ndarray, books: Codebooks, cosine: float, target_recall: float) -> float:
    """Traversal cost within which one of two vectors at ``cosine`` visits the other's cell with the target probability.

    Measured at sampled vectors and partners placed where the data lie (towards the nearest
    other vector), so data of few dimensions are served as well; at least what a partner in
    a direction spread over all dimensions would need.
    """
    most = 2 - 2 * cosine + 1e-9
    if target_recall >= 1:
        return most  # no partner is in a cell beyond
    spread = NormalDist().inv_cdf(target_recall) ** 2 * (2 - 2 * cosine) / x.shape[1]
    q, p = partners(x, cosine)
    if not len(q):
        return most
    (home_q, a, b), (home_p, c, d) = costs(q, books), costs(p, books)
    k, row = len(books[1]), np.arange(len(q))
    there = a[row, home_p // k] + b[row, home_p % k]
    back = c[row, home_q // k] + d[row, home_q % k]
    return min(most, max(spread, 1.1 * float(np.quantile(np.minimum(there, back), target_recall))))


def _valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows with a usable vector ``_v`` (in the input's element type; arithmetic is in double precision)."""
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("_v", lambda x: x == 0)
    return df.withColumn("_v", F.col(vec)).where(F.col("_v").isNotNull() & ~bad & ~zero)


def _assign(index: DataFrame, books: dict[tuple[int, int], Codebooks], limit: dict[tuple[int, int], float]) -> DataFrame:
    """``index`` with ``_cells``, the cells that each vector visits, home first."""
    kept = ["_label", "_rep", "_n", "_v", "_k"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: list[list[int]] = [[0]] * b.num_rows
            words = b.column("_k").to_numpy()
            for at, x in matrices(b.column("_v")):
                for k in np.unique(words[at]).tolist():
                    if (x.shape[1], k) in books:
                        own = words[at] == k
                        for i, c in zip(at[own].tolist(), visit(x[own], books[x.shape[1], k], limit[x.shape[1], k]), strict=True):
                            cells[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(cells, pa.list_(pa.int32()))], names=[*kept, "_cells"])

    kind = lambda c: index.schema[c].dataType.simpleString()
    return index.select(*kept).mapInArrow(assign, f"_label {kind('_label')}, _rep long, _n long, _v {kind('_v')}, _k int, _cells array<int>")


def link_strip(hit: np.ndarray, q: np.ndarray, m: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Lower ``label`` until rows ``q`` and members ``m`` that hit each other agree; labels that met, as (greater, smaller)."""
    met = []
    top = np.iinfo(np.int64).max
    while True:
        low = np.minimum(label[q], np.where(hit, label[m][None, :], top).min(1))
        back = np.minimum(label[m], np.where(hit, low[:, None], top).min(0))
        changed = np.concatenate([label[q] != low, label[m] != back])
        if not changed.any():
            return met
        met.append(np.unique(np.stack([np.concatenate([label[q], label[m]])[changed], np.concatenate([low, back])[changed]]), axis=1))
        label[q] = low
        label[m] = np.minimum(label[m], back)


def _match(cosine: float, books: dict[tuple[int, int], Codebooks], limit: dict[tuple[int, int], float]):
    """Matches a slice of a cell's members with a slice of its visitors; counts per vector and edges of a forest."""

    def blind(x: np.ndarray, k: int, cell: int) -> np.ndarray:
        """Which of the unit vectors ``x`` never visit ``cell``."""
        key = (x.shape[1], k)
        home, a, b = costs(x, books[key])
        i, j = divmod(cell, len(books[key][1]))
        return (a[:, i] + b[:, j] > limit[key]) & (home != cell)

    def match(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        rep, n, home, member = column("_rep"), column("_n"), column("_home"), column("_member")
        cell, k = table.column("_cell")[0].as_py(), table.column("_k")[0].as_py()
        count, label = np.zeros(len(rep), dtype=np.int64), rep.copy()
        met: list[np.ndarray] = []
        for at, x in matrices(table.column("_v").combine_chunks()):
            mine = member[at]
            m, xm = at[mine], x[mine]
            visitors, xv = at[~mine], x[~mine]
            for s in range(0, len(visitors), 512):
                q = visitors[s : s + 512]
                hit = xv[s : s + 512] @ xm.T >= cosine
                hit &= rep[q][:, None] != rep[m][None, :]
                if not (some := hit.any(1)).any():
                    continue
                near = np.flatnonzero(hit.any(0))
                q, hit, own = q[some], hit[some][:, near], m[near]
                count[q] += hit @ n[own]
                met += link_strip(hit, q, own, label)
                away = home[q] != cell  # of these, members that never visit the visitor's cell get the link here
                for other in np.unique(home[q][away]).tolist():
                    of = away & (home[q] == other)
                    count[own] += np.where(blind(xm[near], k, other), n[q[of]] @ hit[of], 0)
        keep = (count > 0) | (label != rep)
        edges = np.concatenate(met, axis=1) if met else np.empty((2, 0), np.int64)
        return pa.table(
            {
                "_rep": pa.array(np.concatenate([rep[keep], edges[0]])),
                "_links": pa.array(np.concatenate([count[keep], np.zeros(edges.shape[1], np.int64)])),
                "_root": pa.array(np.concatenate([label[keep], edges[1]])),
            }
        )

    return match


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if it is small enough."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", target_recall: float = 0.999) -> DataFrame:
    """Per row of ``df``: id, n_links, component_id, kept.  Only rows of equal, non-null label are compared."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_e"), F.col(label).alias("_label"))
    valid = _valid(rows.where("_id IS NOT NULL AND _label IS NOT NULL"), "_e")
    # Equal vectors become one; the key is a digest of their doubles.
    keyed = valid.withColumn("_key", F.sha2(F.concat_ws(",", F.transform("_v", lambda x: F.hex(F.xxhash64(x.cast("double") + F.lit(0.0))))), 256))
    index = write_table(keyed.groupBy("_label", "_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.first("_v").alias("_v")), "vectors")

    level = F.pow(F.lit(2.0), F.round(F.log2(F.sqrt(F.col("_size") / CELL)))).cast("int")
    words = checkpoint(index.groupBy(F.col("_label").alias("_of")).agg(F.count("*").alias("_size")).select("_of", F.least(F.lit(MOST_CODEWORDS), F.greatest(F.lit(1), level)).alias("_k")))
    sized = index.join(_small(words), F.col("_label") == F.col("_of"))
    sample = index.select("_v", F.xxhash64("_rep").alias("h")).orderBy("h").limit(SAMPLE).select("_v").toArrow().column("_v").combine_chunks()
    by_length = {x.shape[1]: x for _, x in matrices(sample)} if len(sample) else {}
    books = fit(by_length, {r["_k"] for r in words.select("_k").distinct().collect()})
    limit = {key: measured_limit(by_length[key[0]], b, cosine, target_recall) for key, b in books.items()}
    placed = write_table(_assign(sized, books, limit).withColumn("_home", F.get("_cells", F.lit(0))), "cells")

    seen = placed.select("_label", F.posexplode("_cells").alias("_p", "_cell")).groupBy("_label", "_cell").agg(F.count("*").alias("_visitors"), F.count_if(F.col("_p") == 0).alias("_members"))
    slices = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("int")
    large = seen.select(F.col("_label").alias("_l"), F.col("_cell").alias("_c"), slices("_members", SLICE).alias("_ms"), slices("_visitors", VISITORS).alias("_vs")).where("_ms > 1 OR _vs > 1")
    large = _small(checkpoint(large))

    def dealt(side: DataFrame, member: bool) -> DataFrame:
        """Copies of a side's rows: one slice of its own kind, all of the other's."""
        cut = side.join(large, (F.col("_label") == F.col("_l")) & (F.col("_cell") == F.col("_c")), "left")
        mine, other = ("_ms", "_vs") if member else ("_vs", "_ms")
        slot = F.pmod(F.xxhash64("_rep"), F.coalesce(mine, F.lit(1))).cast("int")
        all_of = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        pair = (slot.alias("_m"), all_of.alias("_w")) if member else (all_of.alias("_m"), slot.alias("_w"))
        return cut.select("_label", "_cell", *pair, F.lit(member).alias("_member"), "_rep", "_n", "_v", "_home", "_k")

    members = dealt(placed.withColumn("_cell", F.col("_home")), True)
    visits = dealt(placed.withColumn("_cell", F.explode("_cells")), False)
    blocks = members.unionByName(visits).groupBy("_label", "_cell", "_m", "_w")
    found = write_table(blocks.applyInArrow(_match(cosine, books, limit), "_rep long, _links long, _root long"), "links")
    links = found.groupBy("_rep").agg(F.sum("_links").alias("_far"))
    groups = components(found.where("_rep <> _root"), "_rep", "_root")

    reps = index.select("_label", "_key", "_rep", "_n").join(links, "_rep", "left").join(groups, F.col("_rep") == F.col("node"), "left")
    reps = checkpoint(reps.select(F.col("_label").alias("_l"), F.col("_key").alias("_k"), "_n", F.coalesce("_far", F.lit(0)).alias("_far"), F.coalesce("component", "_rep").alias("_c")))
    known = checkpoint(keyed.select("_id", "_label", "_key"))
    linked = known.join(reps, (F.col("_label") == F.col("_l")) & (F.col("_key") == F.col("_k"))).select("_id", (F.col("_far") + F.col("_n") - 1).alias("_links"), "_c")
    invalid = rows.select("_id", "_e", "_label").withColumn("_v", F.col("_e").cast("array<double>"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    alone = invalid.where(F.col("_id").isNull() | F.col("_label").isNull() | F.col("_v").isNull() | F.coalesce(bad, F.lit(False)) | F.coalesce(F.forall("_v", lambda x: x == 0), F.lit(False)))
    out = linked.unionByName(alone.select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_c")))
    return out.select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_c").alias("component_id"), (F.col("_id").eqNullSafe(F.col("_c"))).alias("kept"))


def recall(df: DataFrame, result: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", every: int = 50) -> float:
    """Share of the links of all rows with id divisible by ``every`` that ``result`` has, against brute force.

    Links are verified before they are counted, so a row's links are some of its true ones
    and the count tells how many are missing.  Rows are compared vector by vector: the query
    set against all rows of its label.
    """
    rows = _valid(df.where(F.col(label).isNotNull()), vec).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), "_v")
    asked = rows.where(F.col("_id") % every == 0).withColumnsRenamed({"_id": "_q", "_v": "_qv"})
    rows, asked = (d.withColumn(v, F.col(v).cast("array<double>")) for d, v in ((rows, "_v"), (asked, "_qv")))
    dot = F.aggregate(F.zip_with("_v", "_qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    true = rows.join(asked, "_label").where("_id <> _q").where(dot / norm("_v") / norm("_qv") >= cosine).groupBy("_q").agg(F.count("*").alias("_true"))
    both = true.join(result, F.col("_q") == F.col(id_col)).agg(F.sum("_true").alias("t"), F.sum(F.least("_true", "n_links")).alias("f")).first()
    return 1.0 if not both["t"] else both["f"] / both["t"]
