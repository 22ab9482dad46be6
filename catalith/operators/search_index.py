"""Keyword search through an index of grams, without a scan of the texts.

``build`` numbers the rows, and keeps for every gram (one, two or three characters of the lower-case
fields) the rows that hold it: one posting per gram and block of ``BLOCK`` rows, the rows' places in
the block as gaps.  So a posting is bounded however common its gram.  The rows are spread over all cores;
a task makes postings of its rows some ``WINDOW`` characters at a time (a longer text is in several), so what is
shuffled are arrays of places, and those of one gram and block are merged.  Postings lie in buckets by
the gram's hash and are sorted by gram inside, so a search reads the buckets of its grams, of those the
row groups that may hold them, and nothing else.

``search`` takes any number of needles (or of sets of terms that must all occur) at once.  Per needle and block
the lists of all its grams are intersected, shortest first; where a gram is missing the block is out.  The
rows that remain are joined to the stored texts by number and verified.  A needle of one or two
characters is a gram itself; a blank one finds nothing as a keyword, and everything as terms.

Results are those of ``filters.search_any`` and ``filters.search_all``.  Null fields and array elements
hold nothing; texts of any length and repeated rows are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.plans.storage import dealt, table_path

#: Characters of the longest grams, rows of a block, and buckets of grams.
GRAM, BLOCK, BUCKETS = 3, 65_536, 64
#: Characters of which postings are made at once, at the most.
WINDOW = 2**20

_POSTING = "gram string, block long, n int, gaps array<int>, bucket int"


def grams(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``gram``, a row per distinct gram of a row's text."""
    # The characters are a column of their own: inside a lambda they would be cut anew for each gram.
    cut = df.select(*keep, F.filter(F.split(text, ""), lambda x: x != "").alias("_chars"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_chars") >= n, F.sequence(F.lit(0), F.size("_chars") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*(F.get("_chars", i + j) for j in range(n))))

    return cut.select(*keep, F.explode(F.array_distinct(F.concat(*(runs(n) for n in range(1, GRAM + 1))))).alias("gram"))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Some values in order without repeats; ``np.unique`` hashes them first, which takes several times as long."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def _window_postings(points: np.ndarray, field: np.ndarray, row: np.ndarray, number: np.ndarray, block: int, own: int) -> Iterator[pa.RecordBatch]:
    """Postings of the grams that start at the first ``own`` of some characters; ``field`` and ``row`` number a character's, rows rise with ``number``."""
    there = np.zeros(int(points.max()) + 1, bool)
    there[points] = True
    chars, code = np.flatnonzero(there), (np.cumsum(there) - 1)[points]
    first = int(row[0])
    bits, low = int(len(chars)).bit_length(), int(row[-1] - first).bit_length()
    if GRAM * bits + low > 63:  # a gram and its row don't fit a number: fewer characters are fewer different ones
        half = own // 2
        yield from _window_postings(points[: half + GRAM - 1], field[: half + GRAM - 1], row[: half + GRAM - 1], number, block, half)
        yield from _window_postings(points[half:], field[half:], row[half:], number, block, own - half)
        return
    keys, gram, at = [], np.zeros(len(code), np.int64), row.astype(np.int64) - first
    for n in range(GRAM):  # a gram's characters (from 1) in a number, the last in the lowest bits
        gram = (gram[: len(code) - n] << bits) | (code[n:] + 1)
        whole = field[: len(gram)] == field[n:]
        whole[own:] = False
        keys.append(((gram << low) | at[: len(gram)])[whole])
    both = _distinct(np.concatenate(keys))
    grams_, numbers = both >> low, number[first + (both & ((1 << low) - 1))]
    blocks = numbers // block
    starts = np.flatnonzero(np.concatenate(([True], (grams_[1:] != grams_[:-1]) | (blocks[1:] != blocks[:-1]))))
    texts = ["".join(chr(chars[(g >> s * bits & (1 << bits) - 1) - 1]) for s in range(GRAM - 1, -1, -1) if g >> s * bits) for g in grams_[starts].tolist()]
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(both)), pa.int32()), pa.array(numbers % block, pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(blocks[starts], pa.int64()), places], names=["gram", "block", "places"])


def _make_postings(batches: Iterator[pa.RecordBatch], block: int, window: int) -> Iterator[pa.RecordBatch]:
    """(gram, block, places), in parts, of rows (number, fields)."""
    for b in batches:
        b = b.take(pc.sort_indices(b.column("number")))
        number, fields = b.column("number").to_numpy(), b.column("fields")
        of = np.repeat(np.arange(len(b)), fields.value_lengths().to_numpy(zero_copy_only=False))
        flat = fields.flatten()
        try:
            texts = flat.cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([x.decode(errors="replace") for x in flat.to_pylist()], pa.string())
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(size), 0
        while start < len(texts):  # fields of a window's length in all, or one that is longer
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + window, side="right")))
            points = np.frombuffer("".join(texts[start:end].to_pylist()).encode("utf-32-le"), np.uint32)
            field = np.repeat(np.arange(end - start, dtype=np.int32), size[start:end])
            row = of[start:end][field]
            for s in range(0, len(points), window):
                cut = slice(s, s + window + GRAM - 1)
                yield from _window_postings(points[cut], field[cut], row[cut], number, block, min(window, len(points) - s))
            start = end


def _merge_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of their parts, which come one after the other."""

    def parts() -> Iterator[tuple[str, int, int, np.ndarray]]:
        for b in batches:
            values, ends = b.column("places"), b.column("places").offsets.to_numpy()
            flat = values.values.to_numpy()
            for i, (gram, at, bucket) in enumerate(zip(*(b.column(c).to_pylist() for c in ("gram", "block", "bucket")), strict=True)):
                yield gram, at, bucket, flat[ends[i] : ends[i + 1]]

    made, held = [], 0
    for (gram, at, bucket), same in groupby(parts(), lambda p: p[:3]):
        places = [p[3] for p in same]
        whole = places[0] if len(places) == 1 else _distinct(np.concatenate(places))
        made.append((gram, at, len(whole), np.diff(whole, prepend=0), bucket))
        held += len(whole)
        if held > 2**20:
            yield _batch(made)
            made, held = [], 0
    if made:
        yield _batch(made)


def _batch(postings: list[tuple[str, int, int, np.ndarray, int]]) -> pa.RecordBatch:
    gram, block, n, gaps, bucket = zip(*postings, strict=True)
    ends = pa.array(np.cumsum((0, *n)), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(gaps), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(block, pa.int64()), pa.array(n, pa.int32()), lists, pa.array(bucket, pa.int32())], names=["gram", "block", "n", "gaps", "bucket"])


@dataclass(frozen=True)
class SearchIndex:
    """An index in a folder: ``rows`` and ``grams``."""

    spark: SparkSession
    path: str
    schema: T.StructType

    @classmethod
    def build(cls, df: DataFrame, columns: list[str], arrays: list[str] | None = None, path: str | None = None, spread: bool = False) -> SearchIndex:
        """Index the given fields; all columns of ``df`` are stored and returned by searches.  ``spread``: the rows are on all cores already."""
        spark = df.sparkSession
        some = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: F.lower(x)), lambda x: x.isNotNull()), F.array().cast("array<string>"))
        fields = F.concat(F.array_compact(F.array(*(F.lower(c) for c in columns))), *(some(a) for a in arrays or []))
        # Numbers rise within a task, so a task's rows are blocks of their own.
        stored = (df if spread else dealt(df)).select(F.struct("*").alias("row"), fields.alias("fields")).withColumns({"number": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
        made = cls(spark, path or table_path(spark, "search"), stored.schema)
        stored.write.partitionBy("part").parquet(f"{made.path}/rows")
        block, window = BLOCK, WINDOW
        texts = made.rows().where(F.size("fields") > 0).select("number", F.transform("fields", lambda x: x.cast("binary")).alias("fields"))
        parts = texts.mapInArrow(lambda batches: _make_postings(batches, block, window), "gram string, block long, places array<int>")
        sorted_ = parts.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram", "block")
        sorted_.mapInArrow(_merge_postings, _POSTING).write.partitionBy("bucket").parquet(f"{made.path}/grams")
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def postings(self, wanted: list[str]) -> DataFrame:
        """The lists of the given grams; only their buckets are read."""
        if not wanted:
            return self.spark.createDataFrame([], _POSTING)
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(_bucket(F.col("g"))).collect()})
        return self.spark.read.schema(_POSTING).parquet(f"{self.path}/grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))

    def _terms(self, needles: list[list[str]]) -> DataFrame:
        """(needle, grams): of the longest kind that each term has."""
        rows = [(i, t) for i, terms in enumerate(needles) for t in terms]
        terms = self.spark.createDataFrame(rows, "needle int, term string").withColumn("term", F.lower("term"))
        # Of a term shorter than GRAM the only gram of its own length is the term.
        whole = F.length("gram") == F.least(F.length("term"), F.lit(GRAM))
        return grams(terms, "term", ["needle", "term"]).where(whole).select("needle", "gram").distinct()

    def _matched(self, needles: list[list[str]]) -> DataFrame:
        """(needle, number, row, fields) of rows that hold all grams of a needle."""
        wanted = self._terms(needles).collect()  # as many as the needles have characters
        many = {i: sum(r["needle"] == i for r in wanted) for i in range(len(needles))}
        asked = F.broadcast(self.spark.createDataFrame([(r["needle"], r["gram"], many[r["needle"]]) for r in wanted], "needle int, gram string, wanted int"))
        lists = self.postings(sorted({r["gram"] for r in wanted})).join(asked, "gram")
        whole = lists.groupBy("needle", "block", "wanted").agg(F.sort_array(F.collect_list(F.struct("n", "gaps"))).alias("lists")).where(F.size("lists") == F.col("wanted"))

        def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                needle, number = [], []
                for n, block, lists_ in zip(b.column("needle").to_pylist(), b.column("block").to_pylist(), b.column("lists"), strict=True):
                    held = None
                    for one in lists_.values.field("gaps"):
                        places = np.cumsum(one.values.to_numpy())
                        held = places if held is None else held[np.isin(held, places, assume_unique=True)]
                        if not len(held):
                            break
                    needle.append(np.full(len(held), n, np.int32))
                    number.append(block * BLOCK + held)
                flat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
                yield pa.RecordBatch.from_arrays([flat(needle, pa.int32()), flat(number, pa.int64())], names=["needle", "number"])

        found = whole.select("needle", "block", "lists").mapInArrow(intersect, "needle int, number long")
        # The number's upper part is the task that wrote the row, and so the folder it is in.
        found = found.withColumn("part", F.shiftright("number", 33).cast("int"))
        return found.join(self.rows(), ["part", "number"])

    def search_any(self, needles: list[str]) -> DataFrame:
        """(needle, row): rows where a needle occurs, ignoring case, in any field."""
        asked = [n.strip() for n in needles]
        kept = self._matched([[n] if n else [] for n in asked])
        word = F.lower(_pick(asked))
        return kept.where(F.exists("fields", lambda x: F.contains(x, word))).select(_pick(needles).alias("needle"), "row.*")

    def search_all(self, queries: list[str]) -> DataFrame:
        """(needle, row): rows whose fields, put together with blanks, hold every term of a query."""
        terms = [q.split() for q in queries]
        hay = F.array_join("fields", " ")
        most = max(map(len, terms), default=0)
        holds = [F.coalesce(F.contains(hay, F.lower(_pick([t[i] if i < len(t) else None for t in terms]))), F.lit(True)) for i in range(most)]
        hits = self._matched(terms).where(reduce(and_, holds, F.lit(True))).select("needle", "row")
        if blank := [F.lit(i) for i, t in enumerate(terms) if not t]:
            hits = hits.unionByName(self.rows().select(F.explode(F.array(*blank)).alias("needle"), "row"))
        return hits.select(_pick(queries).alias("needle"), "row.*")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _pick(values: list[str | None]) -> Column:
    """A needle's text by its number."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("needle"))
