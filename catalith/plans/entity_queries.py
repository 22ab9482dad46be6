"""Queries over a whole catalog made from the driver's tables, each with its DuckDB oracle.

Parts become entities with optional metrics, part types categories, and a fifth of the parts
are picked into stacks.  The columns are SQL that both engines read, so the oracle starts
from the same rows, and then states in plain SQL what the catalog's functions compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import scalars as S
from catalith.operators import export, filters, ranking, relations
from catalith.operators.paging import PagedListing
from catalith.plans import schema
from catalith.plans.catalog import Catalog, archived, relevance
from catalith.plans.catalog_queries import _query, _table
from catalith.plans.spec import FilterSpec, active_count, query_string, states
from catalith.plans.storage import dealt, table_path, write_table
from catalith.sources import captured, toml

TODAY = "2024-03-01"
_ON, _CRATE = "p_partkey % 10 <> 9", "p_partkey % 10 <> 9 AND p_partkey % 3 <> 0"
#: The entities' columns, in SQL of both engines.
COLUMNS = {
    "id": "concat('e', p_partkey)",
    "name": "concat(p_name, ' ', p_partkey % 50)",
    "repository": """CASE p_partkey % 4 WHEN 0 THEN concat('https://github.com/o', p_size, '/r', p_partkey, '.git') WHEN 1 THEN concat('https://gitlab.com/g', p_size, '/r', p_partkey, '/')
        WHEN 2 THEN concat('https://codeberg.org/c', p_partkey) ELSE concat('http://example.org/github.com/', p_partkey) END""",
    "category": "lower(p_type)",
    "remarks": "concat('Made by ', p_brand, '.')",
    "crate": "CASE WHEN p_partkey % 3 <> 0 THEN concat('crate-', p_partkey) END",
    "installable": "p_partkey % 5 <> 0",
    "alternatives": "CASE WHEN p_partkey % 2 = 0 THEN split(concat('E', (p_partkey + 1) % 150, ' (new);nothing;E', p_partkey % 5), ';') ELSE split('', ';') END",
    "recommended": "p_partkey % 7 = 0",
    "added": f"CASE WHEN p_partkey % 3 <> 1 THEN DATE '{TODAY}' - CAST(p_partkey % 70 AS INT) + 5 END",
    "on": _ON,
    "stars": f"CASE WHEN {_ON} AND p_partkey % 4 <> 3 THEN p_partkey * 37 % 5000 END",
    "archived": f"CASE WHEN {_ON} THEN p_partkey % 13 = 0 END",
    "stale": f"CASE WHEN {_ON} THEN p_partkey % 17 = 0 END",
    "forge_license": f"CASE WHEN {_ON} AND p_partkey % 6 <> 0 THEN 'BSD-3-Clause' END",
    "last_commit": f"CASE WHEN {_ON} THEN DATE '{TODAY}' - CAST(p_partkey % 900 AS INT) END",
    "has_crate": _CRATE,
    "total": f"CASE WHEN {_CRATE} THEN p_partkey * 7919 % 3000000 END",
    "recent": f"CASE WHEN {_CRATE} AND p_partkey % 4 <> 1 THEN p_partkey * 613 % 90000 END",
    "version": f"CASE WHEN {_CRATE} THEN concat(p_size, '.', p_partkey % 7, '.0') END",
    "msrv": f"CASE WHEN {_CRATE} AND p_partkey % 5 < 3 THEN concat('1.', p_size, CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END) END",
    "crate_license": f"""CASE WHEN {_CRATE} THEN CASE p_partkey % 5 WHEN 0 THEN 'MIT OR Apache-2.0' WHEN 1 THEN 'GPL-3.0-or-later' WHEN 2 THEN 'gpl-3.0+/MIT' WHEN 3 THEN 'Apache-2.0 AND MIT' END END""",
    "stack": "CASE p_partkey % 11 WHEN 0 THEN 'essentials' WHEN 1 THEN 's1' WHEN 2 THEN 's2' END",
    "note": "concat('note ', p_size)",
}
CATEGORIES = ["standard", "small", "economy", "none", "promo", "medium", "large"]
STACKS = ["essentials", "s1", "s2", "s3"]
_E = "e AS (SELECT p_partkey AS key, " + ", ".join(f'{sql} AS "{name}"' for name, sql in COLUMNS.items()) + " FROM part)"
_C = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ") t(ord, cid))"
_RECENT = "coalesce(recent, total, stars, 0)"
#: Entities in known categories with their rank, place and marks.
_V = f"""v AS (SELECT e.*, ord, {_RECENT} AS relevance, coalesce(archived, false) AS gone,
    row_number() OVER (PARTITION BY category ORDER BY coalesce(archived, false), recommended DESC, {_RECENT} DESC, name, id) AS rank,
    row_number() OVER (ORDER BY ord, coalesce(archived, false), recommended DESC, {_RECENT} DESC, name, id) - 1 AS position,
    coalesce(crate_license, forge_license) AS licence, date_diff('day', last_commit, DATE '{TODAY}') AS age FROM e JOIN c ON cid = category)"""
_FAMILY_LIST = """[x FOR x IN [regexp_replace(regexp_replace(regexp_replace(trim(y), '\\++$', ''), '(-or-later)+$', ''), '(-only)+$', '')
    FOR y IN string_split(replace(replace(licence, ' OR ', '/'), ' AND ', '/'), '/')] IF x <> '']"""
_FAMILIES = f"list_filter({_FAMILY_LIST}, lambda x, i: list_position({_FAMILY_LIST}, x) = i)"


def _short(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN printf('%.1fM', {n} / 1000000.0::DOUBLE) WHEN {n} >= 1000 THEN printf('%.1fk', {n} / 1000.0::DOUBLE) ELSE {n}::VARCHAR END"


def _rows(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The entities' columns; ``spread`` computes them on all cores, however few partitions the table comes in."""
    part = _table(spark, sf_dir, "part")
    return (dealt(part) if spread else part).selectExpr("p_partkey AS key", *(f"{sql} AS `{name}`" for name, sql in COLUMNS.items()))


def _metrics() -> F.Column:
    c = F.col
    crate = F.struct(
        c("crate").alias("name"), c("total").alias("downloads_total"), c("recent").alias("downloads_recent"), c("version").alias("latest_version"),
        F.lit(None).cast("date").alias("latest_release"), c("msrv").alias("msrv"), c("crate_license").alias("license"), F.array(F.lit("ann")).alias("owners"),
    )
    metrics = F.struct(
        c("stars").alias("stars"), F.lit(None).cast("long").alias("forks"), F.lit(None).cast("long").alias("open_issues"), c("last_commit").alias("last_commit"),
        c("archived").alias("archived"), c("forge_license").alias("license"), c("last_commit").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("updated_at_raw"),
        c("stale").alias("stale"), F.lit(None).cast("string").alias("error"), F.when(c("has_crate"), crate).alias("crate"),
    )
    return F.when(c("on"), metrics).cast(schema.METRICS)


def catalog(spark: SparkSession, sf_dir: str, spread: bool = False) -> Catalog:
    rows = _rows(spark, sf_dir, spread).withColumn("alternatives", F.filter("alternatives", lambda x: x != ""))
    none = F.array().cast("array<string>")
    entities = rows.withColumns({"homepage": F.lit(None).cast("string"), "successors": none, "related": none, "metrics": _metrics()}).select(*schema.ENTITY.names)
    categories = spark.createDataFrame([(i, c, c.title(), "") for i, c in enumerate(CATEGORIES)], schema.CATEGORY)
    picked = rows.where("stack IS NOT NULL").groupBy("stack").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", F.struct(F.col("id").alias("tool"), "note").alias("p")))), lambda x: x["p"]).alias("p"))
    named = spark.createDataFrame([(s,) for s in STACKS], "id string")
    stacks = named.join(picked, F.col("id") == F.col("stack"), "left").select("id", F.upper("id").alias("name"), F.lit("").alias("description"), F.lit("").alias("intro"), F.coalesce("p", F.array().cast(schema.STACK["picks"].dataType)).alias("picks"))
    return Catalog(entities, categories, stacks)


def _today() -> F.Column:
    return F.lit(TODAY).cast("date")


@_query(f"""
WITH {_E}, {_C}, {_V} SELECT id, rank, position, gone AS archived, coalesce(stale, false) AS stale, recommended,
  CASE WHEN gone THEN 'Deprecated' WHEN coalesce(stale, false) THEN 'Stale' ELSE 'Maintained' END AS status,
  coalesce(date_diff('day', added, DATE '{TODAY}') BETWEEN 0 AND 29, false) AS is_new, coalesce(recent, total, 0) AS downloads,
  {_short("coalesce(recent, total)")} AS downloads_label, format('{{:,}}', total) AS downloads_total_label, coalesce(stars, 0) AS stars, {_short("stars")} AS stars_label,
  version, msrv, CASE WHEN age <= 0 THEN 'today' WHEN age < 7 THEN age || 'd ago' WHEN age < 30 THEN age // 7 || 'w ago' WHEN age < 365 THEN age // 30 || 'mo ago' ELSE age // 365 || 'y ago' END AS last_activity,
  coalesce(strftime(last_commit, '%Y-%m-%d'), '') AS sort_updated, coalesce(strftime(added, '%Y-%m-%d'), '') AS sort_added, licence AS license,
  coalesce(lower(array_to_string({_FAMILIES}, ' ')), '') AS license_token_text,
  lower(name || ' ' || id || ' ' || remarks || ' ' || array_to_string([x FOR x IN alternatives IF x <> ''], ' ')) AS haystack,
  CASE WHEN installable THEN crate END AS install_crate, 'cargo install ' || CASE WHEN installable THEN crate END AS install_command,
  regexp_replace(regexp_replace(regexp_replace(repository, '^https?://', ''), '/+$', ''), '^github[.]com/', '') AS repo_label,
  starts_with(repository, 'https://github.com/') AS is_github, starts_with(repository, 'https://gitlab.') AS is_gitlab, CASE WHEN has_crate THEN 1 ELSE 0 END AS n_owners
FROM v
""")
def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["id", "rank", "position", "archived", "stale", "recommended", "status", "is_new", "downloads", "downloads_label", "downloads_total_label", "stars", "stars_label", "version", "msrv", "last_activity", "sort_updated", "sort_added", "license", "license_token_text", "haystack", "install_crate", "install_command", "repo_label", "is_github", "is_gitlab"]
    return catalog(spark, sf_dir).view(_today()).select(*kept, F.size("owners").alias("n_owners"))


_SPEC = FilterSpec(q=" made  BRAND#1", deprecated=False, msrv="1.40", stack="s1")
_MARKED = f"""m AS (SELECT v.*, coalesce(stack = 's1', false) AS is_pick, coalesce(stack = 'essentials', false) AS is_baseline,
    lower(name || ' ' || id || ' ' || remarks || ' ' || array_to_string([x FOR x IN alternatives IF x <> ''], ' ')) AS hay FROM v),
  f AS (SELECT * FROM m WHERE contains(hay, 'made') AND contains(hay, 'brand#1') AND NOT gone AND split_part(msrv, '.', 2)::INT * 10 + coalesce(nullif(split_part(msrv, '.', 3), ''), '0')::INT <= 400 AND (is_pick OR is_baseline))"""


@_query(f"WITH {_E}, {_C}, {_V}, {_MARKED} SELECT id, category, position, is_pick, is_baseline FROM f")
def browse_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).browse(_SPEC, _today()).select("id", "category", "position", "is_pick", "is_baseline")


@_query(f"WITH {_E}, {_C}, {_V}, {_MARKED} SELECT count(*) AS n_visible, count(*) FILTER (WHERE is_pick) AS n_highlighted FROM f")
def browse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).visible_counts(_SPEC, _today())


@_query(f"WITH {_E}, {_C}, {_V}, {_MARKED} SELECT ord, cid AS category, (SELECT count(*) FROM f WHERE category = cid) AS n FROM c")
def browse_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).category_counts(_SPEC, _today())


@_query(f"WITH {_E}, {_C}, {_V} SELECT id FROM v WHERE recommended AND list_contains([lower(x) FOR x IN {_FAMILIES}], 'mit')")
def browse_recommended_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).browse(FilterSpec(recommended=True, license="mit"), _today()).select("id")


_NEEDLES = ["  RING ", "e1", "Q", "nothing", "", "(NEW)", "brand#1", "no such words"]
_QUERIES = [" made  BRAND#1", "small e1 (new", " ", "ring q", "zzz made"]
_LIST = "[x FOR x IN alternatives IF x <> '']"
_values = lambda items: "(VALUES " + ", ".join(f"('{x}')" for x in items) + ") t(needle)"


@_query(f"""
WITH {_E}, n AS (SELECT needle, lower(trim(needle)) AS w FROM {_values(_NEEDLES)})
SELECT needle, id, row_number() OVER (PARTITION BY needle ORDER BY coalesce(archived, false), {_RECENT} DESC, name, id) AS place FROM e, n
WHERE w <> '' AND (contains(lower(name), w) OR contains(id, w) OR contains(category, w) OR contains(lower(remarks), w) OR len([x FOR x IN {_LIST} IF contains(lower(x), w)]) > 0)
""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several needles at once over names, ids, categories, remarks and the array of alternatives, through the gram index; hits in their order."""
    hits = catalog(spark, sf_dir, spread=True).index(spread=True).search_any(_NEEDLES)
    hits = hits.select("needle", "id", "name", archived().alias("gone"), relevance().alias("relevance"))
    return ranking.rank_in_group(hits, "needle", [F.asc("gone"), F.desc("relevance"), F.asc("name"), F.asc("id")], "place").select("needle", "id", "place")


@_query(f"""
WITH {_E}, h AS (SELECT id, lower(name || ' ' || id || ' ' || category || ' ' || remarks || ' ' || array_to_string({_LIST}, ' ')) AS hay FROM e), n AS (SELECT needle, [x FOR x IN string_split(lower(needle), ' ') IF x <> ''] AS ws FROM {_values(_QUERIES)})
SELECT needle, id FROM h, n WHERE len([x FOR x IN ws IF NOT contains(hay, x)]) = 0
""")
def search_terms_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sets of terms at once, each of which has to occur, through the gram index."""
    return catalog(spark, sf_dir, spread=True).index(spread=True).search_all(_QUERIES).select("needle", "id")


def _place(mode: str, order: str) -> str:
    return f"SELECT '{mode}' AS mode, id, row_number() OVER (PARTITION BY category ORDER BY {order} position) AS place FROM v"


@_query(f"""
WITH {_E}, {_C}, {_V} {_place("unknown", "")} UNION ALL {_place("downloads", "coalesce(recent, total, 0) DESC,")} UNION ALL {_place("stars", "coalesce(stars, 0) DESC,")}
UNION ALL {_place("updated", "last_commit DESC NULLS LAST,")} UNION ALL {_place("added", "added DESC NULLS LAST,")} UNION ALL {_place("name", "lower(name),")}
""")
def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sort_modes(catalog(spark, sf_dir).view(_today()), ["unknown", *ranking.SORT_MODES[1:]], "category", ["id"])


@_query(f"""
WITH {_E}, k AS (SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in STACKS)}) t(sid))
SELECT sid AS id, count(key) AS n_picks, coalesce(list(CASE WHEN installable THEN crate END ORDER BY key) FILTER (WHERE installable AND crate IS NOT NULL), []) AS install_crates,
  coalesce(list(name ORDER BY key) FILTER (WHERE key IS NOT NULL AND (NOT installable OR crate IS NULL)), []) AS uncovered FROM k LEFT JOIN (SELECT * FROM e WHERE key IS NOT NULL) e ON stack = sid WHERE sid <> 'essentials' GROUP BY sid
""")
def stack_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).stack_cards().select("id", F.col("n_picks").cast("long").alias("n_picks"), "install_crates", "uncovered")


@_query(f"WITH {_E} SELECT id AS tool, name, CASE WHEN installable THEN crate END AS install_crate, row_number() OVER (ORDER BY key) - 1 AS pick_ord FROM e WHERE stack = 'essentials'")
def baseline_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).baseline_layer().select("tool", "name", "install_crate", F.col("pick_ord").cast("long").alias("pick_ord"))


@_query(f"WITH {_E} SELECT id AS tool, CASE WHEN stack = 'essentials' THEN note ELSE '' END AS baseline_note, stack = 'essentials' AS is_baseline, CASE WHEN stack <> 'essentials' THEN stack || ':' || note ELSE '' END AS stacks FROM e WHERE stack IS NOT NULL")
def stack_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_join(F.transform("stacks", lambda s: F.concat_ws(":", s["stack_id"], s["note"])), ",")
    return catalog(spark, sf_dir).memberships().select("tool", "baseline_note", "is_baseline", named.alias("stacks"))


@_query(f"""
WITH {_E}, n AS (SELECT 's1' AS active, id AS tool, stack, note FROM e WHERE stack IN ('s1', 'essentials'))
SELECT active, stack AS subject, tool, note, true AS visible FROM n UNION ALL SELECT 's1', sid, NULL, NULL, sid = 's1' FROM (VALUES {", ".join(f"('{s}')" for s in STACKS)}) t(sid) UNION ALL SELECT NULL, sid, NULL, NULL, false FROM (VALUES {", ".join(f"('{s}')" for s in STACKS)}) t(sid)
""")
def notes_and_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    out = c.stack_notes(None).unionByName(c.stack_notes("s1")).select(F.lit("s1").alias("active"), F.col("stack_id").alias("subject"), "tool", "note", F.lit(True).alias("visible"))
    for active in ("s1", None):
        out = out.unionByName(c.banners(active).select(F.lit(active).cast("string").alias("active"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("note"), "visible"))
    return out


@_query(f"""
WITH {_E}, r AS (SELECT id, unnest(range(0, len(a))) AS pos, unnest(a) AS reference FROM (SELECT id, [x FOR x IN alternatives IF x <> ''] AS a FROM e)),
k AS (SELECT lower(id) AS k, id AS t FROM e UNION ALL SELECT lower(name), id FROM e), g AS (SELECT k, min(t) AS t FROM k GROUP BY k)
SELECT id, pos, reference, t AS target FROM r LEFT JOIN g ON k = lower(trim(split_part(reference, '(', 1)))
""")
def relations_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog(spark, sf_dir).relations("alternatives").select("id", F.posexplode("alternatives").alias("pos", "r"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), "r.reference", "r.target")


@_query(f"""
WITH {_E}, x AS (SELECT id, coalesce(crate_license, forge_license) AS licence FROM e), y AS (SELECT id, unnest(f) AS label, unnest(range(0, len(f))) AS pos FROM (SELECT id, {_FAMILIES} AS f FROM x WHERE licence IS NOT NULL)),
o AS (SELECT lower(label) AS key, arg_min(label, (id, pos)) AS label FROM y GROUP BY 1) SELECT key, label, row_number() OVER (ORDER BY key) AS place FROM o
""")
def license_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = catalog(spark, sf_dir).license_options().withColumn("_all", F.lit(0))
    return ranking.rank_in_group(options, "_all", [F.asc("key")], "place").drop("_all")


@_query(f"""
WITH {_E}, o AS (SELECT DISTINCT msrv AS version, split_part(msrv, '.', 2)::INT AS minor, coalesce(nullif(split_part(msrv, '.', 3), ''), '0')::INT AS patch FROM e WHERE msrv IS NOT NULL)
SELECT version, row_number() OVER (ORDER BY minor, patch, version) AS place FROM o
""")
def msrv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = catalog(spark, sf_dir).msrv_options().withColumn("_all", F.lit(0))
    return ranking.rank_in_group(options, "_all", [F.asc("key"), F.asc("version")], "place").select("version", "place")


@_query(f"""
WITH {_E}, d AS (SELECT id, category, key FROM e UNION ALL SELECT id, category, key FROM e WHERE key % 97 = 0),
p AS (SELECT stack, id, key, row_number() OVER (PARTITION BY stack ORDER BY key) AS place FROM e WHERE stack IS NOT NULL),
x AS (SELECT 1 AS part, id AS subject, 0 AS place, 1 AS severity, 'duplicate entity' AS kind, '2' AS detail FROM e WHERE key % 97 = 0
  UNION ALL SELECT 1, id, 0, 2, 'unknown category', category FROM d WHERE category = 'promo'
  UNION ALL SELECT 2, stack, place, 4, 'unknown pick', id FROM p WHERE key % 55 = 12)
SELECT *, row_number() OVER (ORDER BY part, subject, place, severity, detail) = 1 AS is_first FROM x
""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    key = F.substring("id", 2, 20).cast("long")
    # the repeated rows are entities without their metrics; picks lose some of their targets
    rows = c.entities.select("id", "category").unionByName(c.entities.where(key % 97 == 0).select("id", "category"))
    picked = F.transform("picks", lambda p: F.when(F.substring(p["tool"], F.lit(2), F.lit(20)).cast("long") % 55 == 12, p.withField("tool", F.concat(F.lit("gone "), p["tool"]))).otherwise(p))
    found = relations.violations(rows, c.categories.where("id <> 'promo'"), c.stacks.withColumn("picks", picked))
    found = found.withColumn("detail", F.regexp_replace("detail", "^gone ", "")).withColumn("_all", F.lit(0))
    first = [F.asc(x) for x in ("part", "subject", "place", "severity", "detail")]
    return ranking.rank_in_group(found, "_all", first, "_at").withColumn("is_first", F.col("_at") == 1).drop("_all", "_at")


@_query(f"""
WITH {_E}, o AS (SELECT *, CASE key % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'new' WHEN 2 THEN 'failed' WHEN 3 THEN 'new' END AS o FROM e)
SELECT id, CASE WHEN o = 'new' THEN key ELSE stars END AS stars, CASE WHEN o = 'failed' THEN true WHEN o = 'new' THEN false ELSE stale END AS stale, CASE WHEN o = 'failed' THEN 'timeout ' || key END AS error,
  CASE WHEN o = 'new' THEN false WHEN o = 'failed' THEN coalesce(archived, false) ELSE archived END AS archived, CASE WHEN o = 'new' THEN NULL ELSE version END AS version FROM o
""")
def upsert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of four fifths of the entities; two fifths have an older outcome as well, which the newer one replaces."""
    c = catalog(spark, sf_dir)
    key = F.substring("id", 2, 20).cast("long")
    kind = c.entities.schema["metrics"].dataType
    fresh = F.struct(*({"stars": key, "archived": F.lit(False), "stale": F.lit(False)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    one = lambda which, failed, at: c.entities.where((key % 5).isin(*which)).select("id", F.when(F.lit(not failed), fresh).alias("new_metrics"), F.when(F.lit(failed), F.concat(F.lit("timeout "), key.cast("string"))).alias("failure"), F.lit(at).alias("at"))
    outcomes = one([0, 2], True, 2).unionByName(one([1, 3], False, 2)).unionByName(one([2], False, 1)).unionByName(one([3], True, 1))
    m = "metrics."
    return relations.upsert_metrics(c.entities, outcomes).select("id", m + "stars", m + "stale", m + "error", m + "archived", F.col(m + "crate.latest_version").alias("version"))


_HOST = "CASE key % 4 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' WHEN 2 THEN 'codeberg.org' END"
#: Stored bodies, in SQL of both engines; some are no JSON, some have a failing status, some never came.
_FORGE_BODY = """CASE WHEN key % 7 = 0 THEN '<html>rate limited</html>' WHEN key % 4 = 0 THEN concat('{"stargazers_count":', key, ',"forks_count":2,"open_issues_count":3,"pushed_at":"2024-02-28T23:30:00-05:00","archived":', CASE WHEN key % 3 = 0 THEN 'true' ELSE 'false' END, ',"license":{"spdx_id":"', CASE WHEN key % 8 = 0 THEN 'NOASSERTION' ELSE 'MIT' END, '"}}')
  WHEN key % 4 = 1 THEN concat('{"star_count":', key, ',"forks_count":2,"last_activity_at":"2024-02-28T23:30:00Z","license":', CASE WHEN key % 8 = 1 THEN '{"nickname":"N"}' ELSE '{"nickname":null,"name":"L"}' END, '}')
  ELSE concat('{"stars_count":', key, ',"updated_at":"no date"}') END"""
_REGISTRY_BODY = """CASE WHEN key % 19 = 0 THEN '{"crate":' WHEN key % 23 = 0 THEN '{"errors":[]}' ELSE concat('{"crate":{"downloads":', key, ',"recent_downloads":1,"newest_version":"2.0"},"versions":[{"num":"1.0","created_at":"2020-01-01T00:00:00Z","license":"A","rust_version":"1.5"},{"num":"', CASE WHEN key % 2 = 0 THEN '2.0' ELSE '3.0' END, '","created_at":"2024-01-02T00:00:00Z","license":"B","rust_version":null}]}') END"""
#: What the responses come to: the forge's are good, the registry's are good, the failure.
_R = f"""r AS (SELECT *, {_HOST} AS host, key % 4 <> 3 AND key % 29 <> 0 AND key % 7 <> 0 AND key % 31 <> 0 AS good, crate IS NOT NULL AND key % 19 <> 0 AND key % 23 <> 0 AS listed,
  CASE WHEN key % 4 <> 3 AND key % 29 = 0 THEN 'no response' WHEN key % 4 <> 3 AND key % 31 = 0 THEN 'status 503' WHEN key % 4 <> 3 AND key % 7 = 0 THEN 'cannot decode the response'
    WHEN crate IS NOT NULL AND (key % 19 = 0 OR key % 23 = 0) THEN 'cannot decode the response' END AS failure FROM e)"""
_OWNERS_BODY = """'{"users":[{"login":"a","name":"Ann"},{"login":"b","name":null},{"login":null,"name":null}]}'"""


@_query(f"""
WITH {_E}, {_R}
SELECT id, CASE WHEN good THEN key END AS stars, CASE WHEN good THEN coalesce(key % 4 = 0 AND key % 3 = 0, false) END AS archived,
  CASE WHEN good THEN CASE key % 4 WHEN 0 THEN CASE WHEN key % 8 <> 0 THEN 'MIT' END WHEN 1 THEN CASE WHEN key % 8 = 1 THEN 'N' ELSE 'L' END END END AS forge_license,
  CASE WHEN good AND key % 4 < 2 THEN DATE '2024-02-28' END AS last_commit,
  CASE WHEN listed THEN key END AS total, CASE WHEN listed THEN CASE WHEN key % 2 = 0 THEN 'B' ELSE 'A' END END AS crate_license,
  CASE WHEN listed THEN CASE WHEN key % 2 = 0 THEN DATE '2024-01-02' ELSE DATE '2020-01-01' END END AS released, CASE WHEN listed AND key % 2 = 1 THEN '1.5' END AS msrv,
  CASE WHEN listed THEN CASE WHEN key % 5 = 1 THEN '' ELSE 'Ann,b' END END AS owners,
  failure
FROM r
""")
def refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _outcomes(spark, sf_dir)
    f, r = "forge.", "registry."
    listed = F.col(r + "downloads_total").isNotNull()
    return found.select(
        "id", F.col(f + "stars").alias("stars"), F.col(f + "archived").alias("archived"), F.col(f + "license").alias("forge_license"), F.col(f + "last_commit").alias("last_commit"), F.col(r + "downloads_total").alias("total"),
        F.col(r + "license").alias("crate_license"), F.col(r + "latest_release").alias("released"), F.col(r + "msrv").alias("msrv"), F.when(listed, F.array_join(r + "owners", ",")).alias("owners"), "failure",
    )


@_query(f"""
WITH {_E}, {_R} SELECT id, CASE WHEN failure IS NOT NULL THEN stars WHEN good THEN key END AS stars, CASE WHEN failure IS NOT NULL THEN coalesce(archived, false) ELSE coalesce(good AND key % 12 = 0, false) END AS archived,
  failure IS NOT NULL AS stale, failure AS error, CASE WHEN failure IS NOT NULL THEN last_commit WHEN good AND key % 4 < 2 THEN DATE '2024-02-28' END AS last_commit,
  CASE WHEN failure IS NOT NULL THEN total WHEN crate IS NOT NULL THEN key END AS total, CASE WHEN failure IS NOT NULL THEN CASE WHEN has_crate THEN 1 END WHEN crate IS NOT NULL THEN CASE WHEN key % 5 = 1 THEN 0 ELSE 2 END END AS n_owners,
  CASE WHEN failure IS NOT NULL THEN last_commit ELSE DATE '2024-03-02' END AS refreshed FROM r
""")
def refresh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses to metrics tables, applied to the catalog: what failed keeps what was known."""
    fresh = toml.metrics_struct("forge", "registry", F.lit("2024-03-02T01:00:00Z"))
    outcomes = _outcomes(spark, sf_dir).select("id", F.when(F.col("failure").isNull(), fresh).alias("new_metrics"), "failure")
    m = "metrics."
    return relations.upsert_metrics(catalog(spark, sf_dir).entities, outcomes).select(
        "id", m + "stars", m + "archived", m + "stale", m + "error", m + "last_commit", F.col(m + "crate.downloads_total").alias("total"),
        F.when(F.col(m + "crate").isNotNull(), F.size(m + "crate.owners").cast("long")).alias("n_owners"), F.to_date(m + "updated_at").alias("refreshed"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("repository", F.when(F.col("key") % 4 == 2, F.concat(F.lit("https://codeberg.org/c/r"), "key")).otherwise(F.col("repository")))
    response = lambda df, kind, body, status="200": df.selectExpr("id", f"{kind} AS kind", f"{body} AS body", "CAST(NULL AS STRING) AS error", f"CAST({status} AS INT) AS status")
    forges = response(rows.where("key % 4 <> 3 AND key % 29 <> 0"), _HOST, _FORGE_BODY, "CASE WHEN key % 31 = 0 THEN 503 ELSE 200 END")
    registry = response(rows.where("crate IS NOT NULL"), "'registry'", _REGISTRY_BODY)
    owners = response(rows.where("crate IS NOT NULL AND key % 5 <> 1"), "'owners'", _OWNERS_BODY)
    stored = table_path(spark, "responses")
    forges.unionByName(registry).unionByName(owners).write.json(stored)
    return captured.outcomes(rows.select("id", "crate", "repository"), captured.read_responses(spark, stored))


_FACTS = "concat_ws(' · ', total || ' downloads', 'v' || version, 'Rust ' || msrv || '+', stars || ' stars', 'last commit ' || strftime(last_commit, '%Y-%m-%d'), forge_license)"


@_query(f"""
WITH {_E}, {_C}, {_V}, b AS (SELECT ord, category, rank, '- ' || name || CASE WHEN recommended THEN ' [RECOMMENDED]' ELSE '' END || CASE WHEN gone THEN ' [DEPRECATED]' ELSE '' END || ': ' || repository
  || CASE WHEN {_FACTS} <> '' THEN chr(10) || '  ' || {_FACTS} ELSE '' END || chr(10) || '  ' || remarks
  || CASE WHEN len([x FOR x IN alternatives IF x <> '']) > 0 THEN chr(10) || '  alternatives: ' || array_to_string([x FOR x IN alternatives IF x <> ''], ', ') ELSE '' END AS block FROM v)
SELECT ord AS section_order, 0 AS rank, '## ' || upper(category[1]) || category[2:] || ' (' || count(*) || ')' || chr(10) || chr(10) AS text FROM b GROUP BY ord, category
UNION ALL SELECT ord, rank, block || chr(10) || chr(10) FROM b UNION ALL SELECT -1, 0, '# Parts' || chr(10) || 'All of them.' || chr(10) || count(*) || ' entries across ' || count(DISTINCT category) || ' categories.' FROM v
""")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.text_export().unionByName(c.text_header("Parts", "All of them.", noun="entries").select(F.lit(-1).alias("section_order"), F.lit(0).cast("long").alias("rank"), "text"))


@_query(f"""
WITH {_E}, d AS (SELECT strftime(max(last_commit), '%Y-%m-%d') AS d FROM e), k AS (SELECT 0 AS ord, '' AS id UNION ALL SELECT 1, sid FROM (VALUES {", ".join(f"('{s}')" for s in STACKS[1:])}) t(sid))
SELECT ord, id, concat('  <url>', chr(10), '    <loc>https://x.org/', CASE WHEN ord = 1 THEN '?stack=' || id ELSE '' END, '</loc>', chr(10), '    <lastmod>', d, '</lastmod>', chr(10), '    <priority>', CASE ord WHEN 0 THEN '1.0' ELSE '0.7' END, '</priority>', chr(10), '  </url>') AS entry FROM k, d
UNION ALL SELECT -1, '', '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' UNION ALL SELECT 2, '', '</urlset>'
""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).sitemap(export.base_url("https://x.org//", "CATALITH_SITEMAP_URL"))


@_query(f"""
WITH {_E}, p AS (SELECT name || ' ' || key AS name, CASE WHEN key % 4 <> 0 THEN key * 613 % 900 END AS recent, CASE WHEN key % 3 = 0 THEN '1.0' END AS stable, CASE WHEN key % 2 = 0 THEN '2.0' END AS newest,
  'a' || chr(9) || 'b' || chr(10) || repeat('\\', key % 3) || repeat('x', 90) AS description FROM e WHERE key // 100 < 3 AND key // 100 <> 1),
s AS (SELECT name, coalesce(recent, 0) AS recent, coalesce(stable, newest, '') AS version, left('a b ' || description[5:], 80) AS description FROM p),
t AS (SELECT *, row_number() OVER (ORDER BY recent DESC, name) AS place FROM s) SELECT 1 AS ord, name || chr(9) || recent || chr(9) || version || chr(9) || replace(description, '\\', '\\\\') AS line FROM t WHERE place BETWEEN 11 AND 60
UNION ALL SELECT 0, 'name' || chr(9) || 'recent' || chr(9) || 'version' || chr(9) || 'description'
""")
def discover_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of a keyword scan (one can't be decoded and is passed over on purpose, later ones aren't asked for), one page of the listing as TSV."""
    return export.tsv(captured.discover(captured.read_pages(_scan(spark, sf_dir), 2), 50, 10, strict=False), ["name", "recent", "version", "description"])


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of a keyword scan; page 1 can't be decoded."""
    key = F.col("key")
    text = F.concat(F.lit("a\tb\n"), F.expr("repeat('\\\\', CAST(key % 3 AS INT))"), F.lit("x" * 90))
    package = F.struct(
        F.concat("name", F.lit(" "), key.cast("string")).alias("name"), F.when(key % 4 != 0, key * 613 % 900).alias("recent_downloads"), F.when(key % 3 == 0, "1.0").alias("max_stable_version"),
        F.when(key % 2 == 0, "2.0").alias("newest_version"), text.alias("description"),
    )
    pages = _rows(spark, sf_dir).groupBy(F.floor(key / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(package).alias("crates"))).alias("body"))
    pages = pages.withColumns({"body": F.when(F.col("page") == 1, "<html>").otherwise(F.col("body")), "error": F.lit(None).cast("string")})
    return pages


_SCANNED = """p AS (SELECT name || ' ' || key AS name, coalesce(CASE WHEN key % 4 <> 0 THEN key * 613 % 900 END, 0) AS recent FROM e WHERE key // 100 <> 1),
  q AS (SELECT *, row_number() OVER (ORDER BY recent DESC, name) - 1 AS place FROM p)"""


@_query(f"""
WITH {_E}, {_SCANNED} SELECT 'row' AS kind, place // 25 AS page, place, name, recent, NULL AS error FROM q UNION ALL SELECT 'bad page', 1, NULL, NULL, NULL, 'cannot decode the response'
""")
def discover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a keyword scan's listing in order, and the page that can't be read as a row with its error."""
    read = write_table(captured.read_pages(_scan(spark, sf_dir)), "packages")
    rows = _listed(read).rows().select(F.lit("row").alias("kind"), F.expr("place DIV 25").alias("page"), "place", "name", "recent", F.lit(None).cast("string").alias("error"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return rows.unionByName(read.where("page_error IS NOT NULL").select(F.lit("bad page").alias("kind"), "page", none("long", "place"), none("string", "name"), none("long", "recent"), F.col("page_error").alias("error")))


def _listed(packages: DataFrame) -> PagedListing:
    return PagedListing.build(captured.listing(packages, strict=False).select("name", "recent"), F.struct((-F.col("recent")).alias("recent"), F.col("name").alias("name")))


@_query(f"WITH {_E}, {_SCANNED} SELECT kind, place, name, recent FROM q, (VALUES ('number'), ('cursor')) t(kind) WHERE place BETWEEN 50 AND 74")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a listing by its number, and as what follows the second page's last row."""
    paged = _listed(captured.read_pages(_scan(spark, sf_dir)))
    last = paged.page(1, 25).orderBy(F.desc("place")).first()
    cursor = F.struct(F.lit(-last["recent"]).cast("long").alias("recent"), F.lit(last["name"]).alias("name"))
    both = paged.page(2, 25).withColumn("kind", F.lit("number")).unionByName(paged.after(cursor, 25).withColumn("kind", F.lit("cursor")))
    return both.select("kind", "place", "name", "recent")


@_query(f"""
WITH {_E} SELECT id, '{{"title":"' || name || '","downloads":' || coalesce(total::VARCHAR, 'null') || ',"newest":' || coalesce('"' || version || '"', 'null') || '}}' AS json FROM e
""")
def entity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.struct("name", F.struct(F.col("total").alias("sum")).alias("downloads"), F.lit(1).alias("other")).alias("crate"), F.col("version").alias("num")))
    wanted = {"title": "crate.name", "downloads": "crate.downloads.sum", "newest": "num"}
    return _rows(spark, sf_dir).select("id", export.entity_json(body, wanted, "crate struct<name: string, downloads: struct<sum: long>>, num string").alias("json"))


@_query(f"""
WITH {_E}, {_C} SELECT 'entity' AS kind, id, row_number() OVER (ORDER BY id) AS place FROM e UNION ALL SELECT 'category', cid, ord + 1 FROM c
UNION ALL (SELECT 'sample', id, 1 FROM e ORDER BY id <> 'e7', id LIMIT 1) UNION ALL (SELECT 'lookup', id, 1 FROM e WHERE id = 'e12' LIMIT 1)
""")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load order, category references, the sample row and a lookup (one found, one not)."""
    c = catalog(spark, sf_dir)
    listed = c.list_entities().select(F.lit("entity").alias("kind"), "id", F.lit(0).alias("_all"))
    out = ranking.rank_in_group(listed, "_all", [F.asc("id")], "place").drop("_all")
    refs = c.category_references().join(c.categories.select("id", "ord"), "id").select(F.lit("category").alias("kind"), "id", (F.col("ord") + 1).cast("long").alias("place"))
    sample = c.sample("e7").select(F.lit("sample").alias("kind"), F.get_json_object("json", "$.id").alias("id"), F.lit(1).cast("long").alias("place"))
    found = c.get("e12").unionByName(c.get("E12")).select(F.lit("lookup").alias("kind"), "id", F.lit(1).cast("long").alias("place"))
    return out.unionByName(refs).unionByName(sample).unionByName(found)


_URL = "concat('https://x.org/?q=a%20b', key % 3, CASE WHEN key % 2 = 0 THEN '&license=mit' ELSE '&license=none' END, CASE WHEN key % 3 = 0 THEN '&sort=stars' WHEN key % 3 = 1 THEN '&sort=odd' ELSE '' END, CASE WHEN key % 5 = 0 THEN '&deprecated=0' ELSE '&deprecated=1' END, CASE WHEN key % 7 = 0 THEN '&recommended=1' ELSE '' END, '&stack=s', key % 4)"


@_query(f"""
WITH {_E}, s AS (SELECT id, 'a b' || key % 3 AS q, CASE WHEN key % 2 = 0 THEN 'mit' ELSE '' END AS license, CASE WHEN key % 3 = 0 THEN 'stars' ELSE 'default' END AS sort, key % 5 <> 0 AS deprecated, key % 7 = 0 AS recommended,
  CASE WHEN key % 4 IN (1, 2) THEN 's' || key % 4 ELSE '' END AS stack FROM e)
SELECT *, (license <> '')::INT + (sort <> 'default')::INT + (NOT deprecated)::INT + recommended::INT + (stack <> '')::INT AS n_active,
  concat('q=a+b', q[4:], CASE WHEN license <> '' THEN '&license=mit' ELSE '' END, CASE WHEN sort <> 'default' THEN '&sort=stars' ELSE '' END, CASE WHEN NOT deprecated THEN '&deprecated=0' ELSE '' END, CASE WHEN recommended THEN '&recommended=1' ELSE '' END, CASE WHEN stack <> '' THEN '&stack=' || stack ELSE '' END) AS query FROM s
""")
def filter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _rows(spark, sf_dir).selectExpr("id", f"{_URL} AS url")
    read = states(urls, "url", licenses={"mit"}, msrvs=set(), stacks={"s1", "s2"})
    return read.select("id", "q", "license", "sort", "deprecated", "recommended", "stack", active_count().alias("n_active"), query_string().alias("query"))


_STATE_URL = """concat('https://x.org/?q=', CASE key % 6 WHEN 0 THEN 'made%20BRAND%231' WHEN 1 THEN 'e1' WHEN 2 THEN 'zzz' ELSE '' END, CASE key % 5 WHEN 0 THEN '&license=mit' WHEN 1 THEN '&license=gpl-3.0' ELSE '' END,
  CASE key % 4 WHEN 0 THEN '&msrv=1.20' WHEN 1 THEN '&msrv=1.33.1' ELSE '' END, CASE WHEN key % 3 = 0 THEN '&deprecated=0' ELSE '' END, CASE WHEN key % 7 = 0 THEN '&recommended=1' ELSE '' END, CASE WHEN key % 2 = 0 THEN concat('&stack=s', key % 11) ELSE '' END)"""
_STATES = f"""s AS (SELECT id, CASE key % 6 WHEN 0 THEN 'made BRAND#1' WHEN 1 THEN 'e1' WHEN 2 THEN 'zzz' ELSE '' END AS q, CASE key % 5 WHEN 0 THEN 'mit' WHEN 1 THEN 'gpl-3.0' ELSE '' END AS license,
  CASE key % 4 WHEN 0 THEN '1.20' WHEN 1 THEN '1.33.1' ELSE '' END AS msrv, key % 3 <> 0 AS deprecated, key % 7 = 0 AS recommended, CASE WHEN key % 2 = 0 AND key % 11 IN (1, 2) THEN 's' || key % 11 ELSE '' END AS stack FROM e),
  t AS (SELECT DISTINCT q, license, msrv, deprecated, recommended, stack FROM s),
  x AS (SELECT *, [lower(y) FOR y IN {_FAMILIES}] AS families, coalesce(split_part(msrv, '.', 2)::INT * 10 + coalesce(nullif(split_part(msrv, '.', 3), ''), '0')::INT, 9999) AS minor,
    lower(name || ' ' || id || ' ' || remarks || ' ' || array_to_string([z FOR z IN alternatives IF z <> ''], ' ')) AS hay FROM v),
  f AS (SELECT t.*, x.category, coalesce(x.stack = t.stack, false) AS picked FROM t JOIN x ON len([w FOR w IN string_split(lower(t.q), ' ') IF w <> '' AND NOT contains(hay, w)]) = 0
    AND (t.license = '' OR list_contains(families, t.license)) AND (t.msrv = '' OR minor <= CASE t.msrv WHEN '1.20' THEN 200 ELSE 331 END) AND (t.deprecated OR NOT gone) AND (NOT t.recommended OR x.recommended)
    AND (t.stack = '' OR coalesce(x.stack IN (t.stack, 'essentials'), false)))"""
_STATE_KEYS = "q, license, msrv, deprecated, recommended, stack"


def _url_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(_rows(spark, sf_dir, spread=True).selectExpr("id", f"{_STATE_URL} AS url"), "url", stacks={"s1", "s2"})


@_query(f"""
WITH {_E}, {_C}, {_V}, {_STATES}, n AS (SELECT {_STATE_KEYS}, count(*) AS n_visible, count(*) FILTER (picked) AS n_highlighted FROM f GROUP BY ALL)
SELECT id, coalesce(n_visible, 0) AS n_visible, coalesce(n_highlighted, 0) AS n_highlighted FROM s LEFT JOIN n USING ({_STATE_KEYS})
""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every url's filter state shows and highlights, all states counted in one pass over bitmaps."""
    urls = _url_states(spark, sf_dir)
    totals, _ = catalog(spark, sf_dir, spread=True).state_counts(urls)
    return urls.join(totals, _STATE_KEYS.split(", ")).select("id", "n_visible", "n_highlighted")


@_query(f"WITH {_E}, {_C}, {_V}, {_STATES} SELECT {_STATE_KEYS}, category, count(*) AS n FROM f GROUP BY ALL")
def state_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per different filter state, how many entities of each category it shows, where any."""
    return catalog(spark, sf_dir, spread=True).state_counts(_url_states(spark, sf_dir))[1]


@_query(f"""
WITH {_E}, s AS (SELECT key, id, p_size AS size, p_name FROM e JOIN part ON p_partkey = key)
SELECT id, CASE WHEN [size, key % 7, 1, 5000000000 + key % 2] < [20, 3, 1, 5000000000] THEN -1 WHEN [size, key % 7, 1, 5000000000 + key % 2] = [20, 3, 1, 5000000000] THEN 0 ELSE 1 END AS compared,
  p_name AS trimmed, CASE WHEN key % 3 <> 0 THEN 'MIT' END AS known, least(key::HUGEINT * 1000000000000000000, 9223372036854775807)::BIGINT AS capped,
  CASE WHEN key % 2 = 0 THEN DATE '2024-02-28' END AS stamped FROM s
""")
def scalar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (key % 7).cast("string"), F.lit("1"), (F.lit(5_000_000_000) + key % 2).cast("string"))
    return part.select(
        F.concat(F.lit("e"), key.cast("string")).alias("id"), S.compare_versions(version, F.lit("20.3.1.5000000000")).alias("compared"), S.trim_all(F.concat(F.lit("\t  "), "p_name", F.lit(" \r\n"))).alias("trimmed"),
        S.null_if(F.when(key % 3 == 0, "NOASSERTION").otherwise("MIT"), "NOASSERTION").alias("known"), S.saturate(key.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).alias("capped"),
        S.stamp_date(F.when(key % 2 == 0, "2024-02-28T23:30:00-05:00").otherwise("2024-02-28 later")).alias("stamped"),
    )


_TOML = """concat('id = "', id, '"', chr(10), 'name = "', name, '"', chr(10), 'repository = "r"', chr(10), 'category = "', category, '" # kept', chr(10),
  CASE WHEN key % 2 = 0 THEN concat('recommended = true', chr(10)) ELSE '' END, '# by hand', chr(10), CASE WHEN key % 3 = 0 THEN concat('[metrics]', chr(10), 'stars = ', key, chr(10), 'updated_at = "2024-02-28T03:36:46.801146060+00:00"', chr(10), '[metrics.crate]', chr(10), 'name = "c"', chr(10)) ELSE '' END)"""


@_query(f"""
WITH {_E} SELECT id, name, category, key % 2 = 0 AS recommended, true AS installable, '' AS remarks, CASE WHEN key % 3 = 0 THEN key END AS stars, CASE WHEN key % 3 = 0 THEN false END AS stale, CASE WHEN key % 3 = 0 THEN DATE '2024-02-28' END AS refreshed,
  CASE WHEN key % 3 = 0 THEN 0 END AS n_owners, row_number() OVER (ORDER BY concat('/d/', id, '.toml')) AS place FROM e
""")
def toml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as rows: listed in path order, parsed, and bound with defaults for absent keys."""
    files = _rows(spark, sf_dir).selectExpr("concat('/d/', id, '.toml') AS path", f"encode({_TOML}, 'UTF-8') AS content")
    placed = ranking.rank_in_group(files.select("path").withColumn("_all", F.lit(0)), "_all", [F.asc("path")], "place")
    parsed = toml.parse_entities(dealt(files)).select(
        "id", "name", "category", "recommended", "installable", "remarks", F.col("metrics.stars").alias("stars"), F.col("metrics.stale").alias("stale"), F.to_date("metrics.updated_at").alias("refreshed"),
        F.when(F.col("metrics.crate").isNotNull(), F.size("metrics.crate.owners").cast("long")).alias("n_owners"),
    )
    return parsed.join(placed, F.concat(F.lit("/d/"), "id", F.lit(".toml")) == F.col("path")).drop("path", "_all")


@_query(f"""
WITH {_E} SELECT id, concat('id = "', id, '"', chr(10), 'name = "', name, '"', chr(10), 'repository = "r"', chr(10), 'category = "', category, '" # kept', chr(10),
  CASE WHEN key % 2 = 0 THEN concat('recommended = true', chr(10)) ELSE '' END, '# by hand', chr(10), '[metrics]', chr(10), 'stars = ', key + 1, chr(10), 'archived = false', chr(10), 'stale = false', chr(10)) AS text FROM e
""")
def toml_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table of each file replaced; comments, order and spacing of everything else stay."""
    rows = dealt(_rows(spark, sf_dir)).selectExpr("id", f"{_TOML} AS text", "key")
    metrics = F.struct((F.col("key") + 1).alias("stars"), F.lit(None).cast("string").alias("license"), F.lit(False).alias("archived"), F.lit(False).alias("stale"))
    return rows.select("id", toml.replace_table(F.col("text"), "metrics", toml.table_lines(metrics, ["stars", "license", "archived", "stale"])).alias("text"))


@_query("SELECT count(*) AS n, count(DISTINCT p_type) AS n_groups, (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS n_failed FROM part")
def catalog_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = catalog(spark, sf_dir).totals().where("is_total").select("n", "n_groups")
    failed = _rows(spark, sf_dir).agg(F.count_if(F.col("key") % 5 == 0).alias("n_failed"))
    return totals.join(failed)


_MD = "concat('## About ', name, chr(10), chr(10), 'Made by **', crate, '** & ~~nobody~~, see [the <site>](https://x.org/?a=1&b=', key, ') or `a*b*c`.', chr(10), chr(10), '- one *', key, '*', chr(10), '* two')"


@_query(f"""
WITH {_E} SELECT id, concat('<h2>About ', name, '</h2>', chr(10), '<p>Made by <strong>', coalesce(crate, ''), '</strong> &amp; <del>nobody</del>, see <a href="https://x.org/?a=1&amp;b=', key, '">the &lt;site&gt;</a> or <code>a*b*c</code>.</p>', chr(10),
  '<ul>', chr(10), '<li>one <em>', key, '</em></li>', chr(10), '<li>two</li>', chr(10), '</ul>', chr(10)) AS html FROM e WHERE crate IS NOT NULL
""")
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("crate IS NOT NULL").selectExpr("id", f"{_MD} AS md").select("id", export.markdown(F.col("md")).alias("html"))


@_query(f"""
WITH {_E}, {_C}, {_V} SELECT ord, rank, '<article><h3><a href="' || repository || '">' || name || '</a></h3><p>' || remarks || '</p>' || chr(10) || '</article>' AS html FROM v
UNION ALL SELECT DISTINCT ord, 0, '<h2>' || upper(category[1]) || category[2:] || '</h2>' FROM v
""")
def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).grouped().withColumn("_body", export.markdown(F.col("remarks")))
    return export.page_sections(rows, "category_ord", "category_name", "rank", "name", "repository", "_body")


@_query(f"""
WITH {_E}, n AS (SELECT category AS id, count(*) AS n FROM e GROUP BY category)
SELECT id, n, id NOT IN ('small', 'promo') AS is_open, false AS searching FROM n UNION ALL SELECT id, n, true, true FROM n
""")
def section_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that have entities, and which are open: not the collapsed ones, all while a search is active."""
    sections = catalog(spark, sf_dir).entities.groupBy(F.col("category").alias("id")).agg(F.count("*").alias("n"))
    states_ = [export.open_sections(sections, "id", ["small", "promo"], s).withColumn("searching", F.lit(s)) for s in (False, True)]
    return states_[0].unionByName(states_[1])


@_query(f"WITH {_E} SELECT id, (row_number() OVER (ORDER BY id) - 1) * 250 AS not_before_ms FROM e")
def fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured.fetch_schedule(_rows(spark, sf_dir).select("id"))
