"""Nearest neighbours by largest inner product, through a forest of hash-string prefixes.

Each of ``TREES`` trees gives every vector a string of 64 bits: the sides of random orthogonal
hyperplanes on which it lies.  A tree is the sorted array of its strings, so a prefix is a
slice of the array and a node of the tree needs no storage.  Before they are hashed, vectors are
centred (which changes no query's order) and get one more component that makes them equally long
(Neyshabur and Srebro), so that the angle to a query follows the inner product.

A query descends in all trees to its longest matching prefixes by binary search, and counts
the rows under each prefix of its strings on the way (``_counted``).  It then ascends all
trees together, a bit at a time, until the slices hold the required number of candidates; all
of those are compared in double precision (``_nearest``), none is dropped.  The number is measured:
the least with which ``PROBES`` queries, compared with all rows, find ``target_recall`` of their
nearest (``required``); where none suffices, queries ascend to the root and the result is exact.

A tree's array is cut into cells by its first bits (about ``CELL`` rows on average), a large
cell into slices of about ``SLICE`` components, and its visitors likewise, so a block is bounded
whatever the data; a query that ascends above its cell visits every cell under its prefix.
Equal vectors are merged first and their smallest ids kept, so copies cost nothing.

Bounded samples, for the fit only: ``SAMPLE`` vectors for the centre, ``PROBES`` queries for
the number of candidates.  Every vector is in every tree.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, take no part; only vectors of equal length are compared; repeated rows
count once, and a query's own id is never its neighbour (of an id with several vectors the best
counts, and its lists may be shorter); ties go to the smaller id; where there are fewer candidates
than asked for, all are returned; other columns, whatever their names, are not read; an empty
table gives an empty result.  Squared norms have to be finite doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from catalith.llm.embeddings import _valid
from catalith.plans.storage import checkpoint, write_table

TREES, BITS = 16, 64
SAMPLE, PROBES = 20_000, 250
#: Rows of a tree a cell on average; components of rows, and of visitors, in one block at the most.
CELL, SLICE, VISITORS = 65_536, 2**23, 2**20
#: Centre and greatest distance from it, by vector length.
Frame = dict[int, tuple[np.ndarray, float]]
_TOP = np.uint64(1 << 63)


def _rows(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their vectors in double precision."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, _rows(vectors if len(at) == len(size) else vectors.take(pa.array(at)), n)


@lru_cache(maxsize=4)
def hyperplanes(n: int, trees: int) -> np.ndarray:
    """Normals of ``trees * BITS`` hyperplanes in n dimensions, orthogonal within each run of n."""
    rng = np.random.default_rng(11)
    turns = -(-BITS // n)
    return np.concatenate([np.concatenate([np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(turns)], axis=1)[:, :BITS] for _ in range(trees)], axis=1)


def strings(x: np.ndarray, trees: int, extra: np.ndarray) -> np.ndarray:
    """Hash strings (rows x trees) of vectors with their extra component, first bit highest."""
    planes = hyperplanes(x.shape[1] + 1, trees)
    out = np.empty((len(x), trees), np.uint64)
    for s in range(0, len(x), 4096):
        side = (x[s : s + 4096] @ planes[:-1] + extra[s : s + 4096, None] * planes[-1]) > 0
        out[s : s + 4096] = np.packbits(side.reshape(-1, trees, BITS), axis=2).view(">u8")[:, :, 0]
    return out


def hashed(x: np.ndarray, trees: int, frame: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of vectors as rows of the index, and as queries."""
    centre, reach = frame
    y = (x - centre) / (reach or 1.0)
    lift = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(1)))
    return strings(y, trees, lift), strings(x, trees, np.zeros(len(x)))


def _signed(keys: np.ndarray) -> np.ndarray:
    """Strings as longs of the same order."""
    return (keys ^ _TOP).view(np.int64)


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ _TOP


def span(keys: np.ndarray, query: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Slices of the sorted ``keys`` that share the first ``depth`` bits of each query."""
    d = np.broadcast_to(np.asarray(depth, np.uint64), query.shape)
    rest = np.where(d == 0, np.uint64(2**64 - 1), np.where(d >= BITS, np.uint64(0), (np.uint64(1) << (np.uint64(BITS) - np.clip(d, 1, BITS))) - np.uint64(1)))
    return np.searchsorted(keys, query & ~rest, "left"), np.searchsorted(keys, query | rest, "right")


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    x = a ^ b
    high = np.zeros(x.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        up = x >> np.uint64(step)
        high += np.where(up > 0, step, 0)
        x = np.where(up > 0, up, x)
    return np.where(a == b, BITS, BITS - 1 - high)


def _fit(index: DataFrame, trees: int) -> Frame:
    """Centre (of a sample of SAMPLE rows at the most) and greatest distance from it (of all rows), by vector length."""
    sample = index.select("_v", F.xxhash64("_rep").alias("h")).orderBy("h").limit(SAMPLE).select("_v").toArrow().column("_v").combine_chunks()
    centre = {x.shape[1]: x.mean(0) for _, x in by_length(sample)} if len(sample) else {}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for b in batches:
            for _, x in by_length(b.column("_v")):
                n = x.shape[1]
                y = x - centre.get(n, 0.0)
                most[n] = max(most.get(n, 0.0), float(np.sqrt((y * y).sum(1).max())))
        yield pa.RecordBatch.from_pydict({"n": pa.array(most, pa.int32()), "far": pa.array(most.values(), pa.float64())})

    far = index.select("_v").mapInArrow(reach, "n int, far double").groupBy("n").agg(F.max("far").alias("far")).collect()
    return {r["n"]: (centre.get(r["n"], np.zeros(r["n"])), r["far"]) for r in far}


def _planted(index: DataFrame, frame: Frame, trees: int) -> DataFrame:
    """``index`` with each row's strings, as a row (_keys) and, of queries, as a query (_asked)."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in batches:
            keys, asked = np.zeros((b.num_rows, trees), np.int64), np.zeros((b.num_rows, trees), np.int64)
            for at, x in by_length(b.column("_v")):
                own, query = hashed(x, trees, frame[x.shape[1]])
                keys[at], asked[at] = _signed(own), _signed(query)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, trees), pa.int32()), pa.array(a.ravel())).cast(kind)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(keys), lists(asked)], names=[*b.schema.names, "_keys", "_asked"])

    fields = ", ".join(f"{c} {t}" for c, t in index.dtypes)
    return index.mapInArrow(plant, f"{fields}, _keys array<long>, _asked array<long>")


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by.cast("int"))


def _prefix(key: str, bits: str) -> Column:
    """The first bits of a string (a long in the order of strings) as a number; of no bits 0."""
    return F.when(F.col(bits) == 0, F.lit(0)).otherwise(_shifted(F.col(key).bitwiseXOR(F.lit(-(2**63))), F.lit(BITS) - F.col(bits))).cast("long")


def _counted(table: pa.Table) -> pa.Table:
    """Rows of a block under each prefix of each visitor's string, by prefix length (0 above the cell)."""
    column = lambda c: table.column(c).to_numpy()
    member, key = column("_member"), _unsigned(column("_key"))
    keys, query = np.sort(key[member]), key[~member]
    counts = np.zeros((len(query), BITS + 1), np.int64)
    for d in range(table.column("_cut")[0].as_py(), BITS + 1):
        lo, hi = span(keys, query, d)
        counts[:, d] = hi - lo
    return pa.table({"_rep": pa.array(column("_rep")[~member]), "_counts": pa.array(list(counts), pa.list_(pa.int64()))})


def top(score: np.ndarray, q: np.ndarray, m: np.ndarray, rep: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row of ``score`` (queries ``q`` x members ``m`` with ids ``rep``): the best k ids and their inner products.

    Matrix products add up in an order of their own; those that may be among the best are added
    up again from the first component to the last, so that every block gives the same double.
    """
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -np.inf)
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((m * m).sum(1).max())
    for row, x, s in zip(score, q, least - slack, strict=True):
        some = np.flatnonzero(row >= s)
        exact = np.cumsum(m[some] * x, axis=1)[:, -1]
        best = np.lexsort((rep[some], -exact))[:k]
        yield rep[some][best], exact[best]


def _nearest(k: int):
    """The best k of each visitor's slice of a block."""

    def nearest(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        member, key, rep, level = column("_member"), _unsigned(column("_key")), column("_rep"), column("_level")
        of, found = [], []
        ((_, x),) = by_length(table.column("_v").combine_chunks())
        order = np.flatnonzero(member)
        order = order[np.argsort(key[order], kind="stable")]
        keys, m, ids = key[order], x[order], rep[order]
        asked = np.flatnonzero(~member)
        lo, hi = span(keys, key[asked], level[asked].astype(np.uint64))
        slices, of_slice = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
        for j, (a, b) in enumerate(slices.T.tolist()):
            here = asked[of_slice.ravel() == j]
            step = max(1, 4_000_000 // max(1, b - a))
            for s in range(0, len(here) if b > a else 0, step):
                q = here[s : s + step]
                for r, (i, d) in zip(rep[q].tolist(), top(x[q] @ m[a:b].T, x[q], m[a:b], ids[a:b], k), strict=True):
                    of.append(r)
                    found.append([{"_near": n, "_score": y} for n, y in zip(i.tolist(), d.tolist(), strict=True)])
        return pa.table({"_rep": pa.array(of, pa.int64()), "_found": pa.array(found, pa.list_(pa.struct([("_near", pa.int64()), ("_score", pa.float64())])))})

    return nearest


def _probed(planted: DataFrame, k: int, trees: int) -> dict[int, dict[int, np.ndarray]]:
    """By vector length, of PROBES queries at the most: for each of the k nearest of all rows, the level at which the trees meet."""
    asked = planted.where("_asks").select("_rep", "_v", "_asked", F.xxhash64("_rep", F.lit(1)).alias("h")).orderBy("h").limit(PROBES).toArrow()
    if not len(asked):
        return {}
    ids, keys = asked.column("_rep").to_numpy(), _unsigned(np.array(asked.column("_asked").to_pylist(), np.int64))
    probes = {x.shape[1]: (ids[at], x, keys[at]) for at, x in by_length(asked.column("_v").combine_chunks())}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {}
        for b in batches:
            every, strings_ = b.column("_rep").to_numpy(), b.column("_keys").flatten().to_numpy().reshape(-1, trees)
            for at, x in by_length(b.column("_v")):
                if x.shape[1] not in probes:
                    continue
                of, q, asked_ = probes[x.shape[1]]
                score = q @ x.T
                score[of[:, None] == every[at][None, :]] = -np.inf
                near = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                for i, js in enumerate(near):
                    level = shared_bits(_unsigned(strings_[at[js]]), asked_[i][None, :]).max(1)
                    mine = [(float(score[i, j]), int(every[at[j]]), int(n)) for j, n in zip(js, level, strict=True) if score[i, j] > -np.inf]
                    best[int(of[i])] = sorted(best.get(int(of[i]), []) + mine, reverse=True)[:k]
        flat = [(x.shape[1], p, *y) for _, (of, x, _) in probes.items() for p in of.tolist() for y in best.get(p, [])]
        names = ("_n", "_probe", "_score", "_near", "_level")
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], names=list(names))

    near = planted.select("_rep", "_v", "_keys").mapInArrow(compare, "_n int, _probe long, _score double, _near long, _level int")
    place = F.row_number().over(Window.partitionBy("_probe").orderBy(F.desc("_score"), "_near"))
    levels: dict[int, dict[int, list[int]]] = {n: {p: [] for p in of.tolist()} for n, (of, _, _) in probes.items()}
    for r in near.withColumn("_place", place).where(F.col("_place") <= k).collect():
        levels[r["_n"]][r["_probe"]].append(r["_level"])
    return {n: {p: np.array(v) for p, v in of.items()} for n, of in levels.items()}


def required(levels: dict[int, np.ndarray], counts: dict[int, np.ndarray], target_recall: float) -> int:
    """The least number of candidates with which the probes find the target share of their nearest.

    A query ascends to the deepest level at which its trees hold that many rows.
    """
    pairs = [(levels[p], counts[p]) for p in levels if len(levels[p])]
    if not pairs or target_recall >= 1:
        return 2**62
    wanted = np.unique(np.concatenate([c for _, c in pairs]))

    def recall(m: int) -> float:
        ends = [np.flatnonzero(c >= m).max(initial=0) for _, c in pairs]
        return sum((v >= e).sum() for (v, _), e in zip(pairs, ends, strict=True)) / sum(len(v) for v, _ in pairs)

    lo, hi = 0, len(wanted)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if recall(int(wanted[mid])) >= target_recall else (mid + 1, hi)
    return int(wanted[lo]) if lo < len(wanted) else 2**62


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec: str = "embedding", target_recall: float = 0.96, trees: int = TREES) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_e")).where("_id IS NOT NULL")
    valid = _valid(rows, "_e").select("_id", "_v", F.sha2(F.concat_ws(",", F.transform("_v", lambda x: F.hex(F.xxhash64(x.cast("double") + F.lit(0.0))))), 256).alias("_same"))
    asks = F.col("_id") % every == 0
    index = valid.groupBy("_same").agg(F.min("_id").alias("_first"), F.max(asks).alias("_asks"), F.first("_v").alias("_v"))
    # Ids may repeat with other vectors, so representatives get numbers of their own.
    index = write_table(index.withColumn("_rep", F.monotonically_increasing_id()), "vectors")
    copies = valid.select("_same", "_id").distinct().withColumn("_place", F.row_number().over(Window.partitionBy("_same").orderBy("_id"))).where(F.col("_place") <= k + 1)
    ids = checkpoint(copies.groupBy("_same").agg(F.collect_list("_id").alias("_ids")).join(index.select("_same", "_rep"), "_same").select("_rep", "_ids"))

    frame = _fit(index, trees)
    planted = write_table(_planted(index.select("_rep", "_first", "_asks", "_v"), frame, trees), "strings").withColumn("_n", F.size("_v"))
    cuts = {r["_n"]: max(0, int(np.ceil(np.log2(r["n"] / CELL)))) for r in planted.groupBy("_n").agg(F.count("*").alias("n")).collect()}
    cut = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in cuts.items() for x in kv)), F.col("_n")), F.lit(0)) if cuts else F.lit(0)
    planted = planted.withColumn("_cut", cut.cast("int"))

    def strung(side: DataFrame, keys: str) -> DataFrame:
        """A row per tree, with the cell of its string."""
        return side.select(*(c for c in side.columns if c not in ("_keys", "_asked")), F.posexplode(keys).alias("_tree", "_key")).withColumn("_cell", _prefix("_key", "_cut"))

    cell = ["_n", "_tree", "_cell"]
    slices = lambda c, most: F.greatest(F.lit(1), F.ceil(F.col(c) * F.col("_n") / most)).cast("int")
    members = strung(planted.select("_rep", "_n", "_cut", "_v", "_keys"), "_keys")
    cells = checkpoint(members.groupBy(*cell, "_cut").agg(F.count("*").alias("_size")).withColumn("_ms", slices("_size", SLICE)))
    asked = planted.where("_asks").select("_rep", "_n", "_cut", "_asked")

    def blocks(own: DataFrame, visits: DataFrame, places: DataFrame, more: list[str]) -> GroupedData:
        """Slices of a cell's members, each with slices of its visitors (whose cells are ``places``)."""
        busy = places.groupBy(*cell).agg(F.count("*").alias("_visitors")).withColumn("_vs", slices("_visitors", VISITORS))
        sizes = checkpoint(cells.join(busy, cell).select(*cell, "_ms", "_vs"))
        slot = lambda n: F.pmod(F.xxhash64("_rep", "_tree"), n).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def deal(side: DataFrame, m: Column, w: Column, is_member: bool) -> DataFrame:
            return side.join(sizes, cell).select(*cell, "_cut", "_rep", "_key", *more, m.alias("_m"), w.alias("_w"), F.lit(is_member).alias("_member"))

        both = deal(own, slot("_ms"), all_of("_vs"), True).unionByName(deal(visits, all_of("_ms"), slot("_vs"), False))
        return both.groupBy(*cell, "_m", "_w")

    # Descend: rows under each prefix of a query's strings; those shorter than the cells' come from the cells' sizes.
    at_home = strung(asked, "_asked")
    inside = blocks(members.select(*cell, "_cut", "_rep", "_key"), at_home, at_home, []).applyInArrow(_counted, "_rep long, _counts array<long>")
    steps = cells.where("_cut > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)).alias("_depth"))
    above = lambda depth: _shifted(F.col("_cell"), F.col("_cut") - F.col(depth))
    nodes = steps.groupBy("_n", "_tree", "_depth", above("_depth").alias("_node")).agg(F.sum("_size").alias("_under"))
    zero = [F.when(F.col("_depth") == d, F.col("_under")).otherwise(0) for d in range(BITS + 1)]
    higher = at_home.where("_cut > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)).alias("_depth")).withColumn("_node", above("_depth"))
    higher = higher.join(nodes, ["_n", "_tree", "_depth", "_node"]).select("_rep", F.array(*zero).alias("_counts"))
    totals = inside.unionByName(higher).groupBy("_rep").agg(F.array(*(F.sum(F.col("_counts")[d]) for d in range(BITS + 1))).alias("_total"))
    totals = checkpoint(asked.select("_rep", "_n").join(totals, "_rep"))

    levels = _probed(planted, k, trees)
    probes = [p for of in levels.values() for p in of]
    seen = {r["_rep"]: np.array(r["_total"]) for r in totals.where(F.col("_rep").isin(probes)).collect()}
    wanted = {n: required(of, {p: seen[p] for p in of if p in seen}, target_recall) for n, of in levels.items()}
    need = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in wanted.items() for x in kv)), F.col("_n").cast("long")), F.lit(2**62)) if wanted else F.lit(2**62)
    enough = F.filter(F.sequence(F.lit(0), F.lit(BITS)), lambda d: F.get("_total", d) >= need)
    ascended = totals.select("_rep", F.coalesce(F.array_max(enough), F.lit(0)).alias("_level"))

    # Ascend: every cell under the prefix at the query's level.
    ready = asked.join(ascended, "_rep").withColumn("_depth", F.least("_level", "_cut"))
    spread = strung(ready, "_asked").withColumn("_node", above("_depth")).drop("_cell", "_cut")
    under = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("_cut"))).alias("_depth")).select("_n", "_tree", "_depth", above("_depth").alias("_node"), "_cell", "_cut")
    visits = checkpoint(spread.join(under, ["_n", "_tree", "_depth", "_node"]).select(*cell, "_cut", "_rep", "_key", "_level"))
    armed = visits.join(planted.where("_asks").select("_rep", "_v"), "_rep")
    found = blocks(members.withColumn("_level", F.lit(0)), armed, visits, ["_level", "_v"]).applyInArrow(_nearest(k + 1), "_rep long, _found array<struct<_near: long, _score: double>>")

    pairs = found.select("_rep", F.explode("_found").alias("_f")).select("_rep", "_f.*").groupBy("_rep", "_near").agg(F.max("_score").alias("_score"))
    first = planted.select(F.col("_rep").alias("_near"), "_first")
    best = F.row_number().over(Window.partitionBy("_rep").orderBy(F.desc("_score"), "_first", "_near"))
    kept = checkpoint(pairs.join(first, "_near").withColumn("_best", best).where(F.col("_best") <= k + 1).select("_rep", "_near", "_score"))
    near = kept.join(ids.withColumnRenamed("_rep", "_near"), "_near").select("_rep", F.explode("_ids").alias("_other"), "_score")
    # An id may stand for more vectors than one; its best counts.
    near = near.groupBy("_rep", "_other").agg(F.max("_score").alias("_score"))
    place = F.row_number().over(Window.partitionBy("_rep").orderBy(F.desc("_score"), "_other"))
    lists = near.withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("_rep").agg(F.sort_array(F.collect_list(F.struct("_place", F.col("_other"), F.col("_score")))).alias("_list"))
    lists = checkpoint(lists)
    queries = checkpoint(valid.where(asks).select("_id", "_same").distinct().join(index.select("_same", "_rep"), "_same").select("_id", "_rep"))
    own = F.slice(F.filter("_list", lambda x: x["_other"] != F.col("_id")), 1, k)
    out = queries.join(lists, "_rep").select("_id", F.posexplode(own).alias("_pos", "_x"))
    return out.select(F.col("_id").alias("query_id"), (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_x._other").alias(id_col), F.col("_x._score").alias("score"))
