"""The registered catalog queries over the driver's tables, each with its DuckDB oracle.

The tables stand in for a catalog: documents and parts are entities, labels are optional
metrics, languages and part types are categories, orders are stacks of parts, events are a
log of refresh outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import scalars as S
from catalith.operators import export, filters, ranking, relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = "2001-08-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", *columns).join(labels, "doc_id", "left").withColumn("archived", S.flag(F.col("toxic") == 1))


@_query("""
SELECT lang, d.doc_id, row_number() OVER (PARTITION BY lang
  ORDER BY coalesce(toxic = 1, false), coalesce(quality, 0) DESC, n_chars DESC, d.doc_id) AS rank
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("archived"), F.desc(F.coalesce("quality", F.lit(0))), F.desc("n_chars"), F.asc("doc_id")]
    return ranking.rank_in_group(_documents(spark, sf_dir), "lang", order).select("lang", "doc_id", "rank")


@_query("""
WITH r AS (
  SELECT lang, d.doc_id, row_number() OVER (PARTITION BY lang
    ORDER BY coalesce(toxic = 1, false), coalesce(quality, 0) DESC, n_chars DESC, d.doc_id) AS rank
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
) SELECT doc_id, row_number() OVER (ORDER BY lang, rank) - 1 AS position FROM r
""")
def display_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("archived"), F.desc(F.coalesce("quality", F.lit(0))), F.desc("n_chars"), F.asc("doc_id")]
    ranked = ranking.rank_in_group(_documents(spark, sf_dir), "lang", order)
    return ranking.display_position(ranked, F.col("lang"), F.col("rank")).select("doc_id", "position")


@_query("""
SELECT d.doc_id, coalesce(toxic = 1, false) AS archived, n_chars, row_number() OVER (ORDER BY coalesce(toxic = 1, false), n_chars DESC, d.doc_id) AS place
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE contains(lower(text), 'license')
""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = filters.search_any(_documents(spark, sf_dir, "text"), "  LICENSE ", ["text"]).select("doc_id", "archived", "n_chars").withColumn("_all", F.lit(0))
    return ranking.rank_in_group(hits, "_all", [F.asc("archived"), F.desc("n_chars"), F.asc("doc_id")], "place").drop("_all")


@_query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring')
""")
def search_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search_any(_table(spark, sf_dir, "part"), "ring", ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name")


@_query("""
WITH h AS (SELECT p_partkey, lower(coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || coalesce(p_brand, '')) AS hay FROM part)
SELECT p_partkey FROM h WHERE contains(hay, 'large') AND contains(hay, 'ring')
""")
def search_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return filters.search_all(part, " Large  ring", S.haystack(part["p_name"], part["p_type"], part["p_brand"])).select("p_partkey")


@_query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'PROMO'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").where(F.col("p_type") == "PROMO").select("p_partkey", "p_name", "p_type")


@_query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 62")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("doc_id") == 62).select("doc_id", "lang", "source", "n_chars")


@_query("""
SELECT p_partkey, p_type, p_size FROM part WHERE p_size <= 10 AND p_retailprice < 1500 AND p_brand <> 'Brand#1'
""")
def faceted_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [F.col("p_size") <= 10, None, F.col("p_retailprice") < 1500, F.col("p_brand") != "Brand#1"]
    return filters.faceted_filter(_table(spark, sf_dir, "part"), chosen).select("p_partkey", "p_type", "p_size")


@_query("SELECT p_type, count(*) FILTER (WHERE p_size <= 10 AND p_retailprice < 1000) AS n FROM part GROUP BY p_type")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.facet_counts(_table(spark, sf_dir, "part"), "p_type", [F.col("p_size") <= 10, F.col("p_retailprice") < 1000])


@_query("""
SELECT lang, count(*) AS n, lang IS NULL AND grouping(lang) = 1 AS is_total,
       CASE WHEN grouping(lang) = 1 THEN count(DISTINCT lang) ELSE 1 END AS n_groups
FROM documents GROUP BY GROUPING SETS ((lang), ())
""")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_totals(_table(spark, sf_dir, "documents"), "lang")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.orphans(_table(spark, sf_dir, "orders"), "o_orderkey", _table(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey", "o_custkey")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""
WITH r AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(n_name) || ' (built-in)' WHEN 1 THEN ' ' || n_nationkey || ' (old)' ELSE p_name END AS reference
  FROM part JOIN nation ON n_nationkey = p_partkey % 30
), k AS (
  SELECT n_nationkey, lower(n_name) AS a, n_nationkey::VARCHAR AS b FROM nation
)
SELECT p_partkey, reference, (SELECT min(n_nationkey) FROM k WHERE a = lower(trim(split_part(reference, '(', 1))) OR b = lower(trim(split_part(reference, '(', 1)))) AS target FROM r
""")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    part = _table(spark, sf_dir, "part").join(nation, F.col("n_nationkey") == F.col("p_partkey") % 30)
    third = F.col("p_partkey") % 3
    text = F.when(third == 0, F.concat(F.upper("n_name"), F.lit(" (built-in)"))).when(third == 1, F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" (old)"))).otherwise(F.col("p_name"))
    return relations.resolve_references(part.select("p_partkey", text.alias("reference")), "reference", nation, ["n_name", "n_nationkey"], "n_nationkey")


@_query("""
SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey
""")
def ordered_list_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    named = lines.join(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return ranking.ordered_list(named, ["l_orderkey"], "p_name", ["l_linenumber", "l_partkey", "l_suppkey"], "names")


@_query("SELECT l_partkey, l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _table(spark, sf_dir, "lineitem").withColumn("first_line", F.col("l_linenumber"))
    return relations.memberships(edges, "l_partkey", "l_orderkey", ["l_linenumber"], ["first_line"])


@_query("SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS label FROM part WHERE p_name IS NOT NULL GROUP BY 1")
def distinct_first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distinct_first_label(_table(spark, sf_dir, "part"), "p_name", ["p_partkey"])


_SPDX = """CASE p_type WHEN 'PROMO' THEN 'MIT OR Apache-2.0' WHEN 'STANDARD' THEN 'GPL-3.0-or-later' WHEN 'SMALL' THEN 'GPL-3.0+ AND MIT'
  WHEN 'MEDIUM' THEN 'Apache-2.0/MIT' WHEN 'LARGE' THEN 'LGPL-2.1-only' END"""


@_query(f"""
WITH s AS (SELECT {_SPDX} AS e FROM part), x AS (
  SELECT unnest(list_distinct([regexp_replace(regexp_replace(regexp_replace(trim(y), '\\++$', ''), '(-or-later)+$', ''), '(-only)+$', '')
    FOR y IN string_split(replace(replace(e, ' OR ', '/'), ' AND ', '/'), '/')])) AS family FROM s WHERE e IS NOT NULL
) SELECT family, count(*) AS n FROM x WHERE family <> '' GROUP BY family
""")
def license_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.expr(_SPDX).alias("e"))
    return part.select(F.explode(S.license_families(F.col("e"))).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


@_query("""
SELECT DISTINCT p_size || '.' || (p_partkey % 7) AS version, p_size::BIGINT AS major, (p_partkey % 7)::BIGINT AS minor, 0::BIGINT AS patch FROM part
""")
def distinct_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    return ranking.distinct_versions(_table(spark, sf_dir, "part").select(version.alias("v")), "v").select("version", "key.major", "key.minor", "key.patch")


@_query("SELECT p_partkey, p_size || '.' || (p_partkey % 7) AS version FROM part WHERE p_size < 20 OR (p_size = 20 AND p_partkey % 7 <= 3)")
def version_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    return ranking.version_at_most(_table(spark, sf_dir, "part").select("p_partkey", version.alias("version")), "version", "20.3")


@_query(f"SELECT o_orderkey FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '{TODAY}') BETWEEN 0 AND 29")
def is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").where(S.is_new(F.to_date("o_orderdate"), F.lit(TODAY).cast("date"))).select("o_orderkey")


@_query(f"""
WITH d AS (SELECT date_diff('day', o_orderdate::DATE, DATE '{TODAY}') AS d FROM orders)
SELECT CASE WHEN d <= 0 THEN 'today' WHEN d < 7 THEN d || 'd ago' WHEN d < 30 THEN d // 7 || 'w ago' WHEN d < 365 THEN d // 30 || 'mo ago' ELSE d // 365 || 'y ago' END AS label, count(*) AS n
FROM d GROUP BY 1
""")
def relative_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = S.relative_date(F.to_date("o_orderdate"), F.lit(TODAY).cast("date"))
    return _table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, format('{:,}', floor(c_acctbal)::BIGINT) AS label FROM customer WHERE c_acctbal >= 0")
def thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", S.thousands(F.floor("c_acctbal")).alias("label"))


@_query("""
WITH n AS (SELECT floor(o_totalprice)::BIGINT AS n FROM orders UNION ALL SELECT o_orderkey * 50 FROM orders UNION ALL SELECT o_orderkey * 50000 FROM orders)
SELECT CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0::DOUBLE) WHEN n >= 1000 THEN printf('%.1fk', n / 1000.0::DOUBLE) ELSE n::VARCHAR END AS label, count(*) AS n
FROM n GROUP BY 1
""")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    n = orders.select(F.floor("o_totalprice").alias("v")).union(orders.select(F.col("o_orderkey") * 50)).union(orders.select(F.col("o_orderkey") * 50000))
    return n.groupBy(S.compact(F.col("v")).alias("label")).agg(F.count("*").alias("n"))


@_query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(https://)+', ''), '^(http://)+', ''), '/+$', ''), '^github[.]com/', '') AS label FROM pages
""")
def repo_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.repo_label(F.col("url")).alias("label"))


@_query("""
SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_matches(url, '^https?://github[.]com/') AS is_github,
       regexp_matches(url, '^https?://gitlab[.]') AS is_gitlab, count(*) AS n FROM pages GROUP BY ALL
""")
def host_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").groupBy(S.url_host(url).alias("host"), S.is_github(url).alias("is_github"), S.is_gitlab(url).alias("is_gitlab")).agg(F.count("*").alias("n"))


@_query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)
SELECT page_id, s[1] AS owner, regexp_replace(s[2], '([.]git)+$', '') AS repo FROM p WHERE len(s) >= 2
""")
def owner_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.owner_repo(F.col("url")).alias("r")).where("r IS NOT NULL").select("page_id", "r.*")


@_query("""
SELECT d.doc_id, CASE WHEN coalesce(toxic = 1, false) THEN 'Deprecated' WHEN coalesce(quality = 0, false) THEN 'Stale' ELSE 'Maintained' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", S.status_label(F.col("toxic") == 1, F.col("quality") == 0).alias("status"))


@_query("""
SELECT d.doc_id, coalesce(quality, CASE WHEN toxic = 1 THEN 1 END, n_chars, 0)::BIGINT AS relevance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", S.relevance(F.col("quality").cast("long"), F.when(F.col("toxic") == 1, 1).cast("long"), F.col("n_chars")).alias("relevance"))


@_query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def newest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.newest_match(_table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role")], ["role", "turn"])


@_query("""
SELECT user_id, arg_max(value, ts) FILTER (WHERE event_type <> 'error') AS value, arg_max(event_type = 'error', ts) AS stale,
       count(*) FILTER (WHERE event_type <> 'error') AS n_refreshed, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY user_id
""")
def upsert_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.last_good(_table(spark, sf_dir, "events"), "user_id", "ts", "value", F.col("event_type") == "error")


@_query("""
SELECT doc_id, n, '  ' || line AS line FROM (
  SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''))
""")
def lines_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.indent_lines(F.col("text"))).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("n"), "line")


@_query("SELECT strftime(max(o_orderdate), '%-d %b %Y') AS shown, max(o_orderdate)::DATE AS newest FROM orders")
def max_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max(F.to_date("o_orderdate"))
    return _table(spark, sf_dir, "orders").agg(F.date_format(newest, "d MMM yyyy").alias("shown"), newest.alias("newest"))


@_query("""
SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;') AS url FROM pages
""")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", S.xml_escape(F.col("url")).alias("url"))


@_query("""
SELECT p_partkey, concat_ws(' · ', p_brand, CASE WHEN p_size > 25 THEN 'size ' || p_size END, 'type ' || p_type) AS facts FROM part
""")
def facts_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = export.facts(F.col("p_brand"), F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))), F.concat(F.lit("type "), F.col("p_type")))
    return _table(spark, sf_dir, "part").select("p_partkey", facts.alias("facts"))


@_query("""
WITH j AS (SELECT p_type, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_type AS section, rank, '- ' || p_name || chr(10) || '  part ' || p_partkey AS block FROM j
""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_in_group(_table(spark, sf_dir, "part"), "p_type", [F.desc("p_retailprice"), F.asc("p_partkey")])
    block = export.block(F.concat(F.lit("- "), F.col("p_name")), F.concat(F.lit("  part "), F.col("p_partkey").cast("string")))
    return ranked.select(F.col("p_type").alias("section"), "rank", block.alias("block"))


@_query("""
SELECT o_orderkey, '  <url>' || chr(10) || '    <loc>https://example.org/' || o_orderkey || '</loc>' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '    <lastmod>' || strftime(o_orderdate, '%Y-%m-%d') || '</lastmod>' || chr(10) ELSE '' END
  || '    <priority>0.8</priority>' || chr(10) || '  </url>' AS entry FROM orders
""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string"))
    changed = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", export.url_entry(loc, changed, F.lit("0.8")).alias("entry"))


@_query("""
SELECT to_json({'doc_id': d.doc_id, 'lang': lang, 'n_chars': n_chars, 'quality': quality, 'toxic': toxic, 'archived': coalesce(toxic = 1, false)}) AS json FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_rows(_documents(spark, sf_dir))
