"""Best-fit packing through the configuration linear program.

Only the histogram of piece lengths reaches the driver (at most ``capacity`` rows,
whatever the input).  A configuration is a multiset of lengths that fits one sequence;
the linear program asks for the fewest configurations that cover the histogram.
Multiplicative weights keep a price per length, a knapsack dynamic program prices
configurations, and half of the fractional solution is rounded down; the program is then
solved again for what is left, and so on.  Where rounding ends (few pieces, or few of each
length) whole sequences are priced at the program's last prices, by a knapsack bounded by
what is left.  No other packing takes part.  ``solve`` also gives the dual bound.  The plan
is a list of (configuration, how often), whose size depends on ``capacity`` and the
parameters alone, so it is broadcast.

Pieces find their place by rank among the pieces of equal length.  Ranks come from a
count per (task, length) and a prefix sum over tasks: no task ever sees all pieces of one
length, however many there are.

Defined results: null text is the empty text, a document of the end id alone; repeated
rows are packed as often as they occur; null ids are ids like others; texts of any length
are cut into pieces, none is dropped; other columns of the table, whatever their names, are
not read; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.tokens import one_task, word_ids
from catalith.plans.storage import write_table

Plan = list[tuple[dict[int, int], int]]
#: What long pieces are worth more for their length than short ones, at the most.
LEAN = 0.05
#: Part of a fractional solution that is rounded before the program is solved again.
SHARE = 0.5
#: How far below 1 a configuration that is used may be worth at the prices.
SLACK = 0.01


def cut_pieces(df: DataFrame, id_col: str, text: str, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenized pieces: id, piece, start, length, ids_crc32, task and rank among the task's equal lengths."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        with one_task(word_ids(tokenizer_path)) as encoder:
            for b in batches:
                rows: list[tuple[int, int, int, int, int]] = []
                at: list[int] = []
                for i, ids in enumerate(encoder.encode(t.as_py() or b"" for t in b.column("_text"))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        n = len(part) // 4
                        rows.append((piece, start, n, zlib.crc32(part), seen[n]))
                        at.append(i)
                        seen[n] += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False)), pa.array([task] * len(at), pa.int32()), pa.array(cols[4], pa.int64())],
                    names=["_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return source.mapInArrow(cut, schema)


def _knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the largest value of lengths that fit in c; value[l] prices length l, -inf where it can't be used."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (value[1 : c + 1] + best[c - 1 :: -1][:c]).max())
    return best


def _trace(value: np.ndarray, best: np.ndarray, c: int, config: dict[int, int]) -> dict[int, int]:
    while c > 0 and best[c] > 0:
        if best[c] == best[c - 1]:
            c -= 1
            continue
        length = 1 + int((value[1 : c + 1] + best[c - 1 :: -1][:c]).argmax())
        config[length] = config.get(length, 0) + 1
        c -= length
    return config


def fractional(counts: np.ndarray, rounds: int, per_round: int, eps: float) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """Multiplicative weights on the covering program.

    Returns configurations and how often (as fractions), the best prices met, scaled so
    that no configuration is worth more than 1, and what all pieces are worth at them: by
    duality a lower bound on the number of sequences.
    """
    sizes, used = np.arange(len(counts)), counts > 0
    capacity = len(counts) - 1
    n = np.where(used, counts, 1).astype(float)
    weight = np.where(used, n * sizes * (1 + LEAN * sizes / capacity), 0.0)  # first price: the share of a sequence, a little more for long pieces
    found: dict[tuple[tuple[int, int], ...], float] = {}
    price, bound = sizes / capacity, float((counts * sizes).sum() / capacity)
    for _ in range(rounds):
        value = np.where(used, weight / n, -np.inf)
        best = _knapsack(value, capacity)
        if (worth := float(weight.sum() / best[capacity])) > bound:
            price, bound = np.where(used, value / best[capacity], 0.0), worth
        dear = np.argsort(-weight, kind="stable")[:per_round].tolist()
        for length in [0, *dear]:  # 0: the best configuration of all; then the best with each of the dearest lengths
            if length and (not used[length] or value[length] + best[capacity - length] < (1 - eps) * best[capacity]):
                continue
            config = _trace(value, best, capacity - length, {length: 1} if length else {})
            step = min(n[k] / a for k, a in config.items())
            for k, a in config.items():
                weight[k] *= (1 - eps) ** (a * step / n[k])
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + step
        weight /= weight.max()
    return [(dict(k), x) for k, x in found.items()], price, bound


def round_down(parts: list[tuple[dict[int, int], float]], price: np.ndarray, left: np.ndarray, plan: Plan) -> int:
    """Whole parts of ``SHARE`` of the fractional solution, as far as ``left`` lasts; sequences placed.

    Only configurations that are worth (nearly) 1 at the prices are used: by complementary
    slackness others have no place in an optimal solution.
    """
    volume = sum(x * sum(k * a for k, a in c.items()) for c, x in parts)
    scale = SHARE * float((left * np.arange(len(left))).sum()) / volume if volume else 0.0
    placed = 0
    for config, x in sorted(parts, key=lambda p: (-p[1], sorted(p[0].items()))):
        if sum(price[k] * a for k, a in config.items()) < 1 - SLACK:
            continue
        times = min(int(x * scale), *(int(left[k]) // a for k, a in config.items()))
        if times > 0:
            for k, a in config.items():
                left[k] -= a * times
            plan.append((config, times))
            placed += times
    return placed


def bounded_knapsack(left: np.ndarray, price: np.ndarray, room: int) -> dict[int, int]:
    """The most valuable configuration of at most ``room`` that ``left`` still holds; fuller ones win ties."""
    best, takes = np.zeros(room + 1), []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        value = price[length] + length * 1e-9
        if value <= 0:
            continue
        for _ in range(min(int(left[length]), room // length)):
            more = best[:-length] + value
            better = more > best[length:]
            if not better.any():
                break
            best[length:][better] = more[better]
            takes.append((length, better))
    config: dict[int, int] = {}
    for length, better in reversed(takes):
        if room >= length and better[room - length]:
            config[length] = config.get(length, 0) + 1
            room -= length
    return config


def price_rest(left: np.ndarray, price: np.ndarray, plan: Plan) -> None:
    """Column generation on whole sequences: the longest piece left, and the most valuable filling for it."""
    capacity = len(left) - 1
    value = price * (1 + LEAN * np.arange(capacity + 1) / capacity)  # of equal fillings that of the longer pieces: short ones fit anywhere later
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        config = bounded_knapsack(left, value, capacity - longest)
        left[longest] += 1
        config[longest] = config.get(longest, 0) + 1
        times = min(int(left[k]) // a for k, a in config.items())
        for k, a in config.items():
            left[k] -= a * times
        plan.append((config, times))


class Solution(NamedTuple):
    plan: Plan
    #: No plan needs fewer sequences (duality).
    bound: int
    #: Sequences that come from rounding the fractional solutions; the others were priced one by one.
    rounded: int


def solve(histogram: dict[int, int], capacity: int, rounds: int = 48, per_round: int = 100, eps: float = 0.1) -> Solution:
    """Configurations and how often each is used: every piece of the histogram has exactly one slot.

    The program is solved, a share of its solution is rounded down, and the program is
    solved again for what is left, as long as that places at least a twentieth of it; the
    rest is priced a sequence at a time.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: Plan = []
    price, bound, rounded = np.arange(capacity + 1) / capacity, 0.0, 0
    while left.any():
        parts, price, least = fractional(left, rounds, per_round, eps)
        bound = bound or least
        placed = round_down(parts, price, left, plan)
        rounded += placed
        if placed < least / 20:
            break
    price_rest(left, price, plan)
    return Solution(plan, math.ceil(bound - 1e-6), rounded)


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks per length, sorted by (length, first rank)."""
    rows, rank, first = [], {}, 0
    for config, times in plan:
        base = 0
        for length, a in sorted(config.items(), reverse=True):
            rows.append((length, rank.get(length, 0), a, first, base))
            rank[length] = rank.get(length, 0) + a * times
            base += a * length
        first += times
    rows.sort()
    t = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (t[:, 0] << 44) | t[:, 1], "from": t[:, 1], "each": t[:, 2], "first": t[:, 3], "base": t[:, 4]}


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents of ``df``; one row per piece with its sequence and offset.

    Columns: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = write_table(cut_pieces(df, id_col, text, tokenizer_path, capacity, end_id), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(solve(histogram, capacity).plan)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["task", "length"]).select("_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("_before")).alias("_rank"))
    kind = ranked.schema["_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "_rank"))
            at = np.searchsorted(table["key"], (length << 44) | rank, side="right") - 1
            r = rank - table["from"][at]
            seq = table["first"][at] + r // table["each"][at]
            off = table["base"][at] + r % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(seq), pa.array(off)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
