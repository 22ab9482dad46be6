"""Facet counts of many filter states at once, through bucketed bitmaps.

``FacetIndex.build`` numbers the rows and keeps, for every facet and value, a bitmap a bucket of 32,768 rows
(Spark's ``bitmap_*`` functions).  A filter state is a set of criteria that all have to hold, each
met by any of some values; ``visible`` ORs the bitmaps of each different criterion once, however many states
share it, and ANDs them by state and bucket.  Counting is a population count: of the rows shown, of those
under each value of another facet, or of the rows that a highlight marks.  No row is looked at again, and no state is
evaluated by itself.

An ordered facet (versions) is met by all values up to a limit: running ORs over the sorted
values of a bucket give the bitmap at every limit that is asked for.

Results equal those of filtering state by state.  Null facet values match nothing; a criterion with a
value that no row has shows nothing; rows may repeat; an empty table has counts of 0 only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.scalars import version_numbers
from catalith.plans.storage import checkpoint, write_table

#: The facet that every row has, with the value "".
ALL = "*"


def order_key(version: Column) -> Column:
    """A key that sorts versions as ``compare_versions`` does: its numbers without the zeros at the end."""
    numbers = version_numbers(version)
    size = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(numbers, F.lit(1), size)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` as a table with ``pos``, the row's number from 1."""
    return write_table(df.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("pos", F.col("_id") + 1).drop("_id")


def bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, bucket and bits, of rows (keys, pos)."""
    return rows.groupBy(*keys, F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits"))


@dataclass(frozen=True)
class FacetIndex:
    """``values``: facet, value, bucket, bits; ``ordered`` of them are met by all values up to a limit."""

    values: DataFrame
    ordered: tuple[str, ...] = ()

    @classmethod
    def build(cls, rows: DataFrame, facets: dict[str, Column], ordered: tuple[str, ...] = (), more: DataFrame | None = None) -> FacetIndex:
        """Index ``rows`` (with ``pos``) by facets, each an array of a row's values; ``more`` holds further rows (facet, value, pos)."""
        given = {ALL: F.array(F.lit("")), **facets}
        named = [F.transform(F.coalesce(F.array_compact(v), F.array().cast("array<string>")), _tagged(facet)) for facet, v in given.items()]
        flat = rows.select("pos", F.explode(F.concat(*named)).alias("_f")).select("_f.facet", "_f.value", "pos")
        if more is not None:
            flat = flat.unionByName(more.select("facet", "value", "pos"))
        return cls(write_table(bitmaps(flat, ["facet", "value"]), "facets"), ordered)

    def _up_to(self, limits: DataFrame) -> DataFrame:
        """Bitmaps of (facet, value) of an ordered facet: rows whose value is at most the limit ``value``."""
        key = order_key(F.col("value")).alias("_key")
        # A limit is needed in every bucket that has values of its facet: the result has that many rows.
        buckets = self.values.where(F.col("facet").isin(*self.ordered)).select("facet", "bucket").distinct()
        asked = limits.select("facet", "value", key, F.lit(True).alias("_limit")).join(buckets, "facet").withColumn("bits", F.lit(None).cast("binary"))
        there = self.values.where(F.col("facet").isin(*self.ordered)).select("facet", "value", key, F.lit(False).alias("_limit"), "bucket", "bits")
        upto = Window.partitionBy("facet", "bucket").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return there.unionByName(asked).withColumn("bits", F.bitmap_or_agg("bits").over(upto)).where("_limit").select("facet", "value", "bucket", "bits")

    def visible(self, criteria: DataFrame) -> DataFrame:
        """(state, bucket, bits) of the rows that each state shows.

        ``criteria``: state, facet, and ``any``, the array of values of which a row needs one (in
        order, without repeats).  A state needs a row for each of its criteria; one with none has (ALL, [""]).
        """
        criteria = checkpoint(criteria.select("state", "facet", "any").distinct())
        different = criteria.select("facet", "any").distinct()
        single = different.select("facet", "any", F.explode("any").alias("value"))
        plain = single.where(~F.col("facet").isin(*self.ordered, "")).join(self.values, ["facet", "value"]).select("facet", "any", "bucket", "bits")
        if self.ordered:
            wanted = single.where(F.col("facet").isin(*self.ordered))
            upto = self._up_to(wanted.select("facet", "value").distinct())
            plain = plain.unionByName(wanted.join(upto, ["facet", "value"]).select("facet", "any", "bucket", "bits"))
        met = checkpoint(plain.groupBy("facet", "any", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        needed = criteria.groupBy("state").agg(F.count("*").alias("_needed"))
        both = criteria.join(met, ["facet", "any"]).groupBy("state", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_met"))
        return both.join(needed, "state").where(F.col("_met") == F.col("_needed")).select("state", "bucket", "bits")

    def marked(self, shown: DataFrame, marks: DataFrame) -> DataFrame:
        """``shown`` narrowed to a facet's value for each state: marks (state, facet, value)."""
        other = marks.join(self.values, ["facet", "value"]).select("state", "bucket", "bits")
        both = shown.unionByName(other).groupBy("state", "bucket")
        return both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n")).where("_n = 2").drop("_n")

    def by_value(self, shown: DataFrame, facet: str) -> DataFrame:
        """(state, value, n): how many of the rows shown have each value of a facet, where any has."""
        own = self.values.where(F.col("facet") == facet).select("value", "bucket", F.col("bits").alias("_own"))
        pairs = shown.join(own, "bucket").select("state", "value", "bucket", F.explode(F.array("bits", "_own")).alias("bits"))
        both = pairs.groupBy("state", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
        return both.groupBy("state", "value").agg(F.sum("n").alias("n")).where("n > 0")


def _tagged(facet: str):
    return lambda x: F.struct(F.lit(facet).alias("facet"), x.cast("string").alias("value"))


def counts(shown: DataFrame) -> DataFrame:
    """(state, n): rows shown by each state that shows any."""
    return shown.groupBy("state").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
