"""Ranking, sort modes, distinct values and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.scalars import version_key
from catalith.plans.storage import write_table


def running_sums(df: DataFrame, group: list[str], order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Adds, for each amount, its sum over the rows before this one in its group.

    No task needs a whole group: the rows are sorted into ranges (a group of any size is
    spread over many), sums per range and group are few, and a row's sum is that of the
    ranges before plus that of its range's rows before.  Null keys are a group.
    """
    keyed = df.withColumns({f"_a_{k}": v for k, v in amounts.items()})
    placed = write_table(keyed.orderBy(*group, *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    names = [f"_g{i}" for i in range(len(group))]
    ahead = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_range").alias("_r")).agg(*(F.sum(f"_a_{k}").alias(f"_s_{k}") for k in amounts))
    before = sums.select(*names, "_r", *(F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in amounts))
    own = Window.partitionBy(*group, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_a_{k}").over(own), F.lit(0)) for k in amounts})
    same = F.col("_range") == F.col("_r")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return inside.join(before, same).select(*(c for c in df.columns if c not in amounts), *((F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in amounts))


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank inside each group; ``order`` must end in a unique column to be deterministic.

    As :func:`running_sums`, but ranks need no second pass over the sorted rows: Spark numbers the
    rows of a range as it writes them, so a row's rank is its number, less that of its group's first in
    the range, plus the group's rows in the ranges before.  Only the latter two are joined; they are as many as groups and ranges.
    """
    placed = write_table(df.orderBy(*group, *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    names = [f"_g{i}" for i in range(len(group))]
    own = placed.groupBy(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = own.select(*names, "_r", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return placed.join(shift, same).select(*(c for c in df.columns if c != name), (F.col("_at") + F.col("_shift")).alias(name))


def rank_in_group(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """:func:`rank_in_groups` of one column."""
    return rank_in_groups(df, [group], order, name)


def display_position(df: DataFrame, group_order: Column, rank: Column, name: str = "position") -> DataFrame:
    """0-based position over all groups.

    The position is the group's first position plus the rank; the first positions are
    running sums over the groups' sizes, so neither rows nor groups meet in one place.
    """
    keyed = df.withColumns({"_g": group_order, "_r": rank})
    sizes = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    first = running_sums(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("_g")], {"_first": F.col("_n")}).select(F.col("_g").alias("_of"), "_first")
    return keyed.join(first, F.col("_g").eqNullSafe(F.col("_of"))).withColumn(name, (F.col("_first") + F.col("_r") - 1).cast("long")).drop("_g", "_r", "_first", "_of")


#: Sort modes of a listing; unknown modes fall back to the default order.
SORT_MODES = ("default", "downloads", "stars", "updated", "added", "name")


def sort_order(mode: str, position: str = "position", downloads: str = "downloads", stars: str = "stars", updated: str = "sort_updated", added: str = "sort_added", name: str = "name") -> list[Column]:
    """Ordering of a mode; ties and the default mode follow the display position."""
    by = {
        "downloads": F.desc_nulls_last(downloads),
        "stars": F.desc_nulls_last(stars),
        "updated": F.desc_nulls_last(F.nullif(F.col(updated), F.lit(""))),
        "added": F.desc_nulls_last(F.nullif(F.col(added), F.lit(""))),
        "name": F.asc(F.collate(F.col(name), "UNICODE_CI_AI")),
    }
    return [*([by[mode]] if mode in by else []), F.asc(position)]


def sort_modes(view: DataFrame, modes: list[str], group: str, keep: list[str], name: str = "place", position: str = "position", downloads: str = "downloads", stars: str = "stars", updated: str = "sort_updated", added: str = "sort_added", title: str = "name") -> DataFrame:
    """Every row's place inside its group in each of the modes: (mode, ``keep``, ``name``), ordered as :func:`sort_order` does.

    One sort serves all modes: a row goes in once a mode, with nothing but the key of that mode.
    """
    c = F.col
    number = F.create_map(F.lit("downloads"), c(downloads).cast("long"), F.lit("stars"), c(stars).cast("long"))
    text = F.create_map(F.lit("updated"), F.nullif(c(updated), F.lit("")), F.lit("added"), F.nullif(c(added), F.lit("")))
    slim = view.select(group, *keep, c(position).alias("_position"), number.alias("_numbers"), text.alias("_texts"), c(title).alias("_title"), F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    keyed = slim.select(group, *keep, "_position", "mode", F.try_element_at("_numbers", c("mode")).alias("_number"), F.try_element_at("_texts", c("mode")).alias("_text"), F.when(c("mode") == "name", c("_title")).alias("_name"))
    order = [F.desc_nulls_last("_number"), F.desc_nulls_last("_text"), F.asc(F.collate("_name", "UNICODE_CI_AI")), F.asc("_position")]
    return rank_in_groups(keyed, ["mode", group], order, name).select("mode", *keep, name)


def distinct_first_label(df: DataFrame, label: str, order: list[str], key: Column | None = None) -> DataFrame:
    """Distinct values under ``key`` (lower case by default) with the label seen first."""
    key = F.lower(label) if key is None else key
    return df.where(F.col(label).isNotNull()).groupBy(key.alias("key")).agg(F.min_by(label, F.struct(*order)).alias("label"))


def distinct_versions(df: DataFrame, version: str) -> DataFrame:
    """Distinct versions with their numeric key; order by (key, version)."""
    return df.select(F.col(version).alias("version")).where("version IS NOT NULL").distinct().withColumn("key", version_key(F.col("version")))


def version_at_most(df: DataFrame, version: str, limit: str) -> DataFrame:
    """Rows whose version is at most ``limit``; rows without one drop out."""
    return df.where(version_key(F.col(version)) <= version_key(F.lit(limit)))


def ordered_list(df: DataFrame, group: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Values of each group as an array in the given order; null values are left out."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))))
    return df.groupBy(*group).agg(F.transform(pairs, lambda x: x["_v"]).alias(name))


def group_totals(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and in all (group null, ``is_total``) in one pass, and the number of groups."""
    one = df.groupBy(group).agg(F.count("*").alias("n"))
    return one.rollup(group).agg(F.sum("n").alias("n"), F.grouping(group).cast("boolean").alias("is_total"), F.when(F.grouping(group) == 1, F.count(group)).otherwise(1).alias("n_groups"))


def newest_match(df: DataFrame, group: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each group's greatest row."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_top")).select(*group, "_top.*")


def newest_version(versions: Column, newest: Column) -> Column:
    """Of an array of version structs, that whose ``num`` is the newest, else the first."""
    return F.coalesce(F.get(F.filter(versions, lambda v: v["num"] == newest), F.lit(0)), F.get(versions, F.lit(0)))
