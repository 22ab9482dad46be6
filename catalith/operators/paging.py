"""Pages of a sorted listing, each read from its own ranges.

``PagedListing.build`` sorts the rows once into ranges, a folder each, and notes how many rows each range
has and where it begins.  Page n is then in the ranges that cover its places, and what follows a cursor (the
key of the last row that was shown) in the range that holds the cursor and those behind it, as far as
rows are needed; nothing else is read, however far behind the page is.  A cursor stays right when
rows before it come or go, a page number does not.

The key is one ascending column, usually a struct; it has to tell rows apart for pages to be the same
each time.  Pages beyond the end are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.plans.storage import table_path


@dataclass(frozen=True)
class PagedListing:
    """A listing in a folder: ``ranges`` has (range, rows) in order, ``starts`` each range's first key."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ranges: list[tuple[int, int]]
    starts: DataFrame

    @classmethod
    def build(cls, df: DataFrame, key: Column, path: str | None = None, ranges: int | None = None) -> PagedListing:
        """``ranges`` fixes how many there are; by default the sort decides."""
        spark, path = df.sparkSession, path or table_path(df.sparkSession, "pages")
        keyed = df.withColumn("_key", key)
        ordered = keyed.orderBy("_key") if ranges is None else keyed.repartitionByRange(ranges, "_key").sortWithinPartitions("_key")
        placed = ordered.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % 2**33})
        placed.write.partitionBy("_range").parquet(f"{path}/rows")
        rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        # As many rows as the sort had ranges.
        rows.groupBy("_range").agg(F.count("*").alias("n"), F.min("_key").alias("_first")).coalesce(1).write.parquet(f"{path}/ranges")
        starts = spark.read.parquet(f"{path}/ranges")
        return cls(spark, path, placed.schema, sorted((r["_range"], r["n"]) for r in starts.select("_range", "n").collect()), starts)

    def rows(self) -> DataFrame:
        """All rows with ``place``, counted from 0."""
        before = dict(zip((r for r, _ in self.ranges), accumulate((n for _, n in self.ranges), initial=0), strict=False))
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        first = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("_range").cast("long")) if before else F.lit(0)
        return stored.withColumn("place", first + F.col("_at"))

    def page(self, number: int, size: int) -> DataFrame:
        """Rows ``number * size`` to ``(number + 1) * size - 1`` in order, with ``place``."""
        ends = list(accumulate(n for _, n in self.ranges))
        low, high = number * size, (number + 1) * size
        kept = [r for i, (r, n) in enumerate(self.ranges) if ends[i] > low and ends[i] - n < high]
        rows = self.rows().where(F.col("_range").isin(kept))
        return rows.where(F.col("place").between(low, high - 1)).orderBy("place").drop("_key", "_range", "_at")

    def after(self, cursor: Column, size: int) -> DataFrame:
        """The ``size`` rows that follow a key, in order, with ``place``."""
        began = {r["_range"]: r["b"] for r in self.starts.select("_range", (F.col("_first") <= cursor).alias("b")).collect()}
        order = [r for r, _ in self.ranges]
        at = max(0, bisect_right([not began[r] for r in order], False) - 1)
        kept, held = order[at : at + 1], 0
        for r, n in self.ranges[at + 1 :]:
            if held >= size:
                break
            kept.append(r)
            held += n
        return self.rows().where(F.col("_range").isin(kept) & (F.col("_key") > cursor)).orderBy("_key").limit(size).drop("_key", "_range", "_at")
