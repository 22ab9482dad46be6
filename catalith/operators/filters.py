"""Keyword search, faceted filtering and live facet counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.scalars import compare_versions


def search_any(df: DataFrame, needle: str, columns: list[str], arrays: Iterable[str] = ()) -> DataFrame:
    """Rows where one substring occurs, ignoring case, in any column or array element; a blank needle finds nothing."""
    word = needle.strip().lower()
    if not word:
        return df.where(F.lit(False))
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False)) for c in columns]
    hits += [F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), F.lit(word))), F.lit(False)) for a in arrays]
    return df.where(reduce(or_, hits))


def search_all(df: DataFrame, query: str, hay: Column) -> DataFrame:
    """Rows whose (lower-case) haystack holds every term of the query; a blank query keeps all."""
    terms = query.lower().split()
    return df.where(reduce(and_, (F.contains(hay, F.lit(t)) for t in terms))) if terms else df


def at_most_version(column: str, limit: str) -> Column:
    """True where the version is at most ``limit``, over any number of parts; unknown versions are out."""
    return F.coalesce(compare_versions(F.col(column), F.lit(limit)) <= 0, F.lit(False))


def faceted_filter(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """Rows that pass every active predicate; inactive ones are None."""
    active = [p for p in predicates if p is not None]
    return df.where(reduce(and_, active)) if active else df


def facet_counts(df: DataFrame, group: str, predicates: Iterable[Column | None]) -> DataFrame:
    """Rows per group after the filter; groups that end up empty stay with 0.

    One conditional aggregation: counting and keeping the empty groups need no join.
    """
    active = [p for p in predicates if p is not None]
    passed = F.coalesce(reduce(and_, active), F.lit(False)) if active else F.lit(True)
    return df.groupBy(group).agg(F.count_if(passed).alias("n"))


def membership_marks(df: DataFrame, key: str, picks: DataFrame, stack: str | None, baseline: str) -> DataFrame:
    """Marks ``is_pick`` and ``is_baseline`` (baseline only where a stack is active and the row is no pick)."""
    mine = picks.where((F.col("stack_id") == stack) | (F.col("stack_id") == baseline))
    marks = mine.groupBy(F.col("tool").alias("_key")).agg(F.max(F.col("stack_id").eqNullSafe(F.lit(stack))).alias("_p"), F.max(F.col("stack_id") == baseline).alias("_b"))
    joined = df.join(marks, df[key] == F.col("_key"), "left")
    pick = F.coalesce("_p", F.lit(False)) if stack is not None else F.lit(False)
    base = F.coalesce("_b", F.lit(False)) & ~pick & F.lit(stack is not None)
    return joined.withColumns({"is_pick": pick, "is_baseline": base}).drop("_key", "_p", "_b")


def stack_filter(marked: DataFrame, stack: str | None) -> DataFrame:
    """Picks of the active stack and baseline members; everything where no stack is active."""
    return marked if stack is None else marked.where("is_pick OR is_baseline")


def valid_option(requested: DataFrame, value: str, options: DataFrame, option: str) -> DataFrame:
    """Requested values that are on the option list."""
    return requested.join(options.select(F.col(option).alias("_o")).distinct(), F.col(value) == F.col("_o"), "left_semi")
