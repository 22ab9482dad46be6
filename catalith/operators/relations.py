"""References, memberships, integrity and the last-known-good upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from catalith.functions.scalars import ascii_lower, relation_name


def reference_keys(entities: DataFrame, names: list[str], rank: str) -> DataFrame:
    """Every name an entity answers to, with the first entity (by ``rank``) that does."""
    keys = F.explode(F.array_distinct(F.array(*(ascii_lower(F.col(n).cast("string")) for n in names))))
    return entities.select(keys.alias("_key"), F.col(rank).alias("_rank")).where("_key IS NOT NULL").groupBy("_key").agg(F.min("_rank").alias("target"))


def resolve_references(references: DataFrame, reference: str, entities: DataFrame, names: list[str], rank: str) -> DataFrame:
    """Adds ``target``: the first entity any of whose names equals the reference's, ignoring ASCII case.

    "Name equals or id equals" would be a nested-loop join; one row per name makes it a
    plain equi-join.  References that resolve to nothing keep a null target.
    """
    keyed = references.withColumn("_ref", ascii_lower(relation_name(F.col(reference))))
    return keyed.join(reference_keys(entities, names, rank), F.col("_ref") == F.col("_key"), "left").drop("_ref", "_key")


def resolve_array(df: DataFrame, key: str, array: str, entities: DataFrame, names: list[str], rank: str, name: str) -> DataFrame:
    """Per row of ``df`` (unique ``key``) the array's references as (reference, target), in order."""
    flat = df.select(key, F.posexplode_outer(array).alias("_pos", "_reference"))
    found = resolve_references(flat, "_reference", entities, names, rank)
    pair = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.col("_reference").alias("reference"), "target"))
    return found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.struct(x["reference"].alias("reference"), x["target"].alias("target"))).alias(name))


def memberships(edges: DataFrame, member: str, group: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each (member, group) once, with the ``keep`` columns of its first edge."""
    return edges.groupBy(member, group).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")).select(member, group, "_first.*")


def membership_lists(edges: DataFrame, member: str, group: str, order: list[str], note: str, baseline: str) -> DataFrame:
    """Per member: its groups other than the baseline, in order, and its baseline note ('' if none)."""
    first = memberships(edges, member, group, order, [note])
    stacks = F.sort_array(F.collect_list(F.when(F.col(group) != baseline, F.struct(group, note))))
    base = F.coalesce(F.max(F.when(F.col(group) == baseline, F.col(note))), F.lit(""))
    return first.groupBy(member).agg(stacks.alias("stacks"), base.alias("baseline_note"), F.max(F.col(group) == baseline).alias("is_baseline"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` without a parent; null-safe, unlike NOT IN."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def violations(entities: DataFrame, categories: DataFrame, stacks: DataFrame) -> DataFrame:
    """All broken rules as (part, subject, place, severity, kind, detail); the first to report is the smallest.

    Rows are met in id order, entities before stacks; a row's repeated id comes before its
    references, and these in their order.
    """
    picks = stacks.select(F.col("id").alias("stack"), F.posexplode("picks").alias("place", "p")).select("stack", (F.col("place") + 1).alias("place"), F.col("p.tool").alias("tool"))
    none = F.lit(0)
    row = lambda df, part, n, kind, subject, detail, place=none: df.select(F.lit(part).alias("part"), subject.alias("subject"), place.alias("place"), F.lit(n).alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail"))
    parts = [
        row(duplicate_keys(entities, ["id"]), 1, 1, "duplicate entity", F.col("id"), F.col("n").cast("string")),
        row(orphans(entities, "category", categories.withColumnRenamed("id", "_cid"), "_cid"), 1, 2, "unknown category", F.col("id"), F.col("category")),
        row(duplicate_keys(stacks, ["id"]), 2, 3, "duplicate stack", F.col("id"), F.col("n").cast("string")),
        row(orphans(picks, "tool", entities, "id"), 2, 4, "unknown pick", F.col("stack"), F.col("tool"), F.col("place")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_metrics(entities: DataFrame, outcomes: DataFrame, key: str = "id", metrics: str = "metrics") -> DataFrame:
    """Apply refresh outcomes (``key``, ``new_metrics``, ``failure``) to the metrics struct.

    A success replaces the whole struct, so nothing old survives in it; a failure keeps
    what was known and marks it stale with the message; rows without an outcome stay.  Of
    several outcomes of one key the newest counts where ``outcomes`` has a column ``at``, else
    the one with the greatest failure (a failure before a success).
    """
    newest = F.col("at") if "at" in outcomes.columns else F.lit(0)
    outcomes = outcomes.groupBy(key).agg(F.max_by(F.struct("new_metrics", "failure"), F.struct(newest, F.coalesce("failure", F.lit("")))).alias("_o")).select(key, "_o.*")
    kind = entities.schema[metrics].dataType
    empty = F.lit(None).cast(kind)
    blank = F.struct(*(F.lit(False).alias(f.name) if f.name in ("archived", "stale") else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
    known = F.coalesce(F.col(metrics), blank.cast(kind))
    failed = known.withField("stale", F.lit(True)).withField("error", F.col("_failure"))
    done = outcomes.select(F.col(key).alias("_key"), F.col("new_metrics").cast(kind).alias("_new"), F.col("failure").alias("_failure"), F.lit(True).alias("_seen"))
    joined = entities.join(done, entities[key] == F.col("_key"), "left")
    value = F.when(F.col("_failure").isNotNull(), failed).when(F.col("_seen"), F.coalesce("_new", empty)).otherwise(F.col(metrics))
    return joined.withColumn(metrics, value).drop("_key", "_new", "_failure", "_seen")


def last_good(df: DataFrame, key: str, time: str, value: str, failed: Column) -> DataFrame:
    """Per key over an outcome log: the last good value, whether the last outcome failed, and counts."""
    good = F.when(~failed, F.struct(time, F.col(value).alias("_v")))
    return df.groupBy(key).agg(F.max(good)["_v"].alias("value"), F.max_by(failed, F.col(time)).alias("stale"), F.count_if(~failed).alias("n_refreshed"), F.count_if(failed).alias("n_failed"))


def counted(outcomes: DataFrame, failure: str = "failure") -> tuple[DataFrame, Observation]:
    """``outcomes``, and what will be known of them once they have been written anywhere: ``n``, ``n_failed``, ``n_refreshed``.

    The counts are gathered while the rows pass by; no second pass over them is needed.  A row that a retried task
    reads again is counted once.
    """
    seen = Observation()
    failed = F.col(failure).isNotNull()
    return outcomes.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(~failed).alias("n_refreshed")), seen
