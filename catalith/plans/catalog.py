"""The catalog: loading, integrity, lookups, grouping, views and exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import scalars as S
from catalith.operators import bitmap_facets, export, filters, ranking, relations
from catalith.operators.search_index import SearchIndex
from catalith.plans import schema
from catalith.plans.spec import FilterSpec
from catalith.plans.storage import checkpoint
from catalith.sources import toml, toml_files

#: The stack that every other one builds on (fixed value; a parameter everywhere).
BASELINE = "essentials"


@dataclass(frozen=True)
class Catalog:
    entities: DataFrame
    categories: DataFrame
    stacks: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str, entities: str = "entities") -> Catalog:
        """Read and check a catalog folder; the first broken rule is raised.  ``entities`` names the folder of its rows.

        Where Spark's reader would keep the driver a record of every file, the data source packs them; it reaches mounted folders.
        """
        path = f"{folder}/{entities}"
        rows = toml_files.read(spark, path).select(*schema.ENTITY.names) if toml_files.mounted(spark, path) else toml.read_entities(spark, path)
        made = cls(rows.cache(), toml.read_categories(spark, f"{folder}/categories.toml").cache(), toml.read_stacks(spark, f"{folder}/stacks").cache())
        made.validate()
        return made

    def validate(self) -> None:
        first = relations.violations(self.entities, self.categories, self.stacks).orderBy("part", "subject", "place", "severity", "detail").first()
        if first is not None:
            raise ValueError(f"{first['kind']}: {first['subject']} ({first['detail']})")

    def get(self, entity_id: str) -> DataFrame:
        return self.entities.where(F.col("id") == entity_id).limit(1)

    def list_entities(self, category: str | None = None) -> DataFrame:
        """Entities in id order, of one category if given; unknown categories have none."""
        found = self.entities if category is None else self.entities.where(F.col("category") == category)
        return found.orderBy("id")

    def sample(self, preferred: str) -> DataFrame:
        """One pretty JSON row: the preferred entity, else the first."""
        return export.json_rows(self.entities.orderBy(F.col("id") != preferred, "id").limit(1), pretty=True)

    def search(self, needle: str) -> DataFrame:
        """Keyword search over name, id, category, remarks and alternatives; live before archived, then relevance."""
        hits = filters.search_any(self.entities, needle, ["name", "id", "category", "remarks"], ["alternatives"])
        return hits.withColumns({"archived": archived(), "relevance": relevance()}).orderBy("archived", F.desc("relevance"), "name", "id")

    def index(self, spread: bool = False) -> SearchIndex:
        """An index for many searches over what :meth:`search` looks at; ``spread``: the entities are on all cores already."""
        return SearchIndex.build(self.entities, ["name", "id", "category", "remarks"], ["alternatives"], spread=spread)

    def grouped(self) -> DataFrame:
        """Entities of every non-empty category with ``category_ord``, ``rank`` and ``position``."""
        joined = self.entities.join(self.categories.select(F.col("id").alias("category"), F.col("ord").alias("category_ord"), F.col("name").alias("category_name"), F.col("description").alias("category_description")), "category")
        order = [F.asc(archived()), F.desc("recommended"), F.desc(relevance()), F.asc("name"), F.asc("id")]
        return ranking.display_position(ranking.rank_in_group(joined, "category", order), F.col("category_ord"), F.col("rank"))

    def resolve(self, references: DataFrame, reference: str) -> DataFrame:
        """References with the entity they mean: by id or name, ignoring case and qualifiers."""
        return relations.resolve_references(references, reference, self.entities, ["id", "name"], "id")

    def relations(self, kind: str) -> DataFrame:
        """Per entity its ``kind`` relations (alternatives, successors, related) resolved, in order."""
        return relations.resolve_array(self.entities, "id", kind, self.entities, ["id", "name"], "id", kind)

    def picks(self) -> DataFrame:
        """Stack picks in order (stack_id, pick_ord, tool, note)."""
        return self.stacks.select(F.col("id").alias("stack_id"), F.posexplode("picks").alias("pick_ord", "_p")).select("stack_id", "pick_ord", "_p.tool", "_p.note")

    def memberships(self, baseline: str = BASELINE) -> DataFrame:
        return relations.membership_lists(self.picks(), "tool", "stack_id", ["pick_ord"], "note", baseline)

    def stack_cards(self, baseline: str = BASELINE) -> DataFrame:
        """Per stack but the baseline: pick count, crates to install, names that have none."""
        crate = S.install_crate(F.col("installable"), F.col("crate"), F.col("metrics.crate.name"))
        named = self.picks().join(self.entities.select(F.col("id").alias("tool"), "name", crate.alias("_crate")), "tool")
        lists = named.groupBy("stack_id").agg(
            F.sort_array(F.collect_list(F.when(F.col("_crate").isNotNull(), F.struct("pick_ord", F.col("_crate").alias("v"))))).alias("_c"),
            F.sort_array(F.collect_list(F.when(F.col("_crate").isNull(), F.struct("pick_ord", F.col("name").alias("v"))))).alias("_n"),
        )
        values = lambda c: F.coalesce(F.transform(c, lambda x: x["v"]), F.array().cast("array<string>"))
        cards = self.stacks.where(F.col("id") != baseline).join(lists, F.col("id") == F.col("stack_id"), "left")
        return cards.select("id", "name", "description", "intro", F.size("picks").alias("n_picks"), values("_c").alias("install_crates"), values("_n").alias("uncovered"))

    def baseline_layer(self, baseline: str = BASELINE) -> DataFrame:
        """The baseline's picks that are entities: pick_ord, tool, name, crate to install."""
        crate = S.install_crate(F.col("installable"), F.col("crate"), F.col("metrics.crate.name")).alias("install_crate")
        return self.picks().where(F.col("stack_id") == baseline).join(self.entities.select(F.col("id").alias("tool"), "name", crate), "tool").select("pick_ord", "tool", "name", "install_crate")

    def view(self, today: Column) -> DataFrame:
        """The listing's row per entity: position, labels, sort keys, haystack, licence tokens."""
        m = "metrics."
        licence = F.coalesce(m + "crate.license", m + "license")
        families = F.coalesce(S.license_families(licence), F.array().cast("array<string>"))
        downloads = F.coalesce(m + "crate.downloads_recent", m + "crate.downloads_total", F.lit(0)).cast("long")
        iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
        install = S.install_crate(F.col("installable"), F.col("crate"), F.col(m + "crate.name"))
        return self.grouped().select(
            "id", "name", "category", "category_ord", "category_name", "rank", "position", "recommended",
            archived().alias("archived"),
            S.flag(F.col(m + "stale")).alias("stale"),
            S.status_label(F.col(m + "archived"), F.col(m + "stale")).alias("status"),
            S.is_new(F.col("added"), today).alias("is_new"),
            downloads.alias("downloads"),
            S.compact(F.coalesce(m + "crate.downloads_recent", m + "crate.downloads_total")).alias("downloads_label"),
            S.thousands(F.col(m + "crate.downloads_total")).alias("downloads_total_label"),
            F.coalesce(m + "stars", F.lit(0)).alias("stars"),
            S.compact(F.col(m + "stars")).alias("stars_label"),
            F.col(m + "crate.latest_version").alias("version"),
            F.col(m + "crate.msrv").alias("msrv"),
            S.relative_date(F.col(m + "last_commit"), today).alias("last_activity"),
            iso(m + "last_commit").alias("sort_updated"),
            iso("added").alias("sort_added"),
            licence.alias("license"),
            families.alias("license_families"),
            F.transform(families, F.lower).alias("license_tokens"),
            F.array_join(F.transform(families, F.lower), " ").alias("license_token_text"),
            S.haystack(F.col("name"), F.col("id"), F.col("remarks"), F.array_join("alternatives", " ")).alias("haystack"),
            install.alias("install_crate"),
            F.concat(F.lit("cargo install "), install).alias("install_command"),
            S.repo_label(F.col("repository")).alias("repo_label"),
            S.is_github(F.col("repository")).alias("is_github"),
            S.is_gitlab(F.col("repository")).alias("is_gitlab"),
            F.coalesce(m + "crate.owners", F.array().cast("array<string>")).alias("owners"),
        )

    def facet_index(self, terms: list[str] = ()) -> bitmap_facets.FacetIndex:
        """Bitmaps of everything that a filter state asks for; ``terms`` are the search terms that any state holds."""
        crate, m = F.col("metrics.crate"), "metrics."
        families = S.license_families(F.coalesce(m + "crate.license", m + "license"))
        hay = S.haystack(F.col("name"), F.col("id"), F.col("remarks"), F.array_join("alternatives", " "))
        known = self.entities.join(self.categories.select(F.col("id").alias("category")), "category", "left_semi")
        rows = bitmap_facets.numbered(known.select("id", "category", hay.alias("hay"), archived().alias("archived"), "recommended", F.transform(families, F.lower).alias("licenses"), crate["msrv"].alias("msrv")))
        one = lambda c: F.array(F.col(c).cast("string"))
        facets = {"category": one("category"), "archived": one("archived"), "recommended": one("recommended"), "license": F.array_distinct("licenses"), "msrv": one("msrv")}
        more = self.picks().select("stack_id", "tool").distinct().join(rows, F.col("tool") == F.col("id")).select(F.lit("stack").alias("facet"), F.col("stack_id").alias("value"), "pos")
        if terms:
            hits = SearchIndex.build(rows.select("pos", "hay"), ["hay"]).search_all(list(terms))
            more = more.unionByName(hits.select(F.lit("term").alias("facet"), F.lower("needle").alias("value"), "pos"))
        return bitmap_facets.FacetIndex.build(rows, facets, ("msrv",), more)

    def state_counts(self, states: DataFrame, baseline: str = BASELINE) -> tuple[DataFrame, DataFrame]:
        """Counts of many filter states (``spec.states`` columns) in one pass.

        Returns (state columns, n_visible, n_highlighted), and (state columns, category, n) of categories with any.
        The different search terms of all states pass through the driver.
        """
        keys = ["q", "license", "msrv", "deprecated", "recommended", "stack"]
        words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("q"), r"\s+"), lambda t: t != "")))
        different = checkpoint(states.select(*keys).distinct().withColumns({"state": F.xxhash64(*keys), "words": words}))
        terms = [r[0] for r in different.select(F.explode("words")).distinct().collect()]
        index = self.facet_index(sorted(terms))
        c = F.col
        need = lambda facet, active, *values: F.when(active, F.struct(F.lit(facet).alias("facet"), F.array(*values).alias("any")))
        fixed = F.array(
            need(bitmap_facets.ALL, F.lit(True), F.lit("")),
            need("archived", ~c("deprecated"), F.lit("false")),
            need("recommended", c("recommended"), F.lit("true")),
            need("license", c("license") != "", c("license")),
            need("msrv", c("msrv") != "", c("msrv")),
            need("stack", c("stack") != "", c("stack"), F.lit(baseline)),
        )
        searched = F.transform("words", lambda t: F.struct(F.lit("term").alias("facet"), F.array(t).alias("any")))
        criteria = different.select("state", F.explode(F.concat(F.array_compact(fixed), searched)).alias("_c")).select("state", "_c.*")
        shown = checkpoint(index.visible(criteria))
        picked = index.marked(shown, different.where("stack <> ''").select("state", F.lit("stack").alias("facet"), c("stack").alias("value")))
        n = lambda df, name: bitmap_facets.counts(df).withColumnRenamed("n", name)
        totals = different.join(n(shown, "n_visible"), "state", "left").join(n(picked, "n_highlighted"), "state", "left")
        zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
        by_category = different.join(index.by_value(shown, "category"), "state").select(*keys, c("value").alias("category"), "n")
        return totals.select(*keys, zero("n_visible"), zero("n_highlighted")), by_category

    def shown(self, spec: FilterSpec, today: Column, baseline: str = BASELINE) -> DataFrame:
        """The listing's rows under a filter state, marked."""
        marked = filters.membership_marks(self.view(today), "id", self.picks(), spec.stack or None, baseline)
        return filters.stack_filter(filters.faceted_filter(marked, spec.predicates()), spec.stack or None)

    def browse(self, spec: FilterSpec, today: Column, baseline: str = BASELINE) -> DataFrame:
        """The listing under a filter state, marked and sorted inside categories."""
        return self.shown(spec, today, baseline).orderBy("category_ord", *ranking.sort_order(spec.sort))

    def category_counts(self, spec: FilterSpec, today: Column, baseline: str = BASELINE) -> DataFrame:
        """Visible entities per category; empty categories stay with 0."""
        marked = filters.membership_marks(self.view(today), "id", self.picks(), spec.stack or None, baseline)
        stack = (F.col("is_pick") | F.col("is_baseline")) if spec.stack else None
        counted = filters.facet_counts(marked, "category", [*spec.predicates(), stack])
        return self.categories.select(F.col("ord"), F.col("id").alias("category")).join(counted, "category", "left").select("ord", "category", F.coalesce("n", F.lit(0)).alias("n"))

    def visible_counts(self, spec: FilterSpec, today: Column, baseline: str = BASELINE) -> DataFrame:
        """One row: rows shown, and highlighted ones (picks of the active stack) among them."""
        return self.shown(spec, today, baseline).agg(F.count("*").alias("n_visible"), F.count_if("is_pick").alias("n_highlighted"))

    def category_references(self) -> DataFrame:
        return self.categories.select("id", "name")

    def stack_notes(self, active: str | None, baseline: str = BASELINE) -> DataFrame:
        """Notes on picks (stack, pick_ord, tool, note) that a listing shows: of the active stack, and the baseline's if any is active."""
        shown = F.lit(False) if not active else F.col("stack_id").isin(active, baseline)
        return self.picks().where(shown)

    def banners(self, active: str | None) -> DataFrame:
        """Stacks with ``visible``: a stack's banner shows while it is active."""
        return self.stacks.select("id", "name", F.col("id").eqNullSafe(F.lit(active)).alias("visible"))

    def license_options(self) -> DataFrame:
        licence = F.coalesce("metrics.crate.license", "metrics.license")
        flat = self.entities.select("id", F.posexplode(S.license_families(licence)).alias("pos", "label"))
        return ranking.distinct_first_label(flat, "label", ["id", "pos"]).orderBy("key")

    def msrv_options(self) -> DataFrame:
        return ranking.distinct_versions(self.entities.select(F.col("metrics.crate.msrv").alias("msrv")), "msrv").orderBy("key", "version")

    def totals(self) -> DataFrame:
        return ranking.group_totals(self.grouped(), "category")

    def refreshed(self) -> DataFrame:
        """The newest refresh date, as text."""
        return self.grouped().agg(F.date_format(F.max(F.to_date("metrics.updated_at")), "d MMM yyyy").alias("refreshed"))

    def text_export(self) -> DataFrame:
        """Rows (section_order, rank, text): a heading per category, a block per entity."""
        c = "metrics.crate."
        facts = export.facts(
            F.concat(F.col(c + "downloads_total").cast("string"), F.lit(" downloads")),
            F.concat(F.lit("v"), F.col(c + "latest_version")),
            F.concat(F.lit("Rust "), F.col(c + "msrv"), F.lit("+")),
            F.concat(F.col("metrics.stars").cast("string"), F.lit(" stars")),
            F.concat(F.lit("last commit "), F.date_format("metrics.last_commit", "yyyy-MM-dd")),
            F.col("metrics.license"),
        )
        flags = F.concat(F.when(F.col("recommended"), " [RECOMMENDED]").otherwise(""), F.when(archived(), " [DEPRECATED]").otherwise(""))
        block = export.block(
            F.concat(F.lit("- "), F.col("name"), flags, F.lit(": "), F.col("repository")),
            F.when(facts != "", F.concat(F.lit("  "), facts)),
            export.indented(F.col("remarks")),
            export.list_line("alternatives", F.col("alternatives")),
            export.list_line("use instead", F.col("successors")),
            export.list_line("related", F.col("related")),
        )
        return export.sections(self.grouped().withColumn("_block", block), "category_ord", "category_name", "category_description", "rank", "_block").orderBy("section_order", "rank")

    def text_header(self, title: str, *about: str, noun: str = "entities") -> DataFrame:
        """One row (text): title, lines about the catalog, and its totals of what ``noun`` calls them."""
        totals = self.totals().where("is_total").select(F.concat(F.col("n").cast("string"), F.lit(f" {noun} across "), F.col("n_groups").cast("string"), F.lit(" categories.")).alias("_t"))
        return totals.select(F.concat_ws("\n", F.lit(f"# {title}"), *(F.lit(x) for x in about), "_t").alias("text"))

    def sitemap(self, base_url: str, baseline: str = BASELINE) -> DataFrame:
        return export.sitemap(self.entities, self.stacks, base_url, baseline).orderBy("ord", "id")


def archived() -> Column:
    return S.flag(F.col("metrics.archived"))


def relevance() -> Column:
    return S.relevance(F.col("metrics.crate.downloads_recent"), F.col("metrics.crate.downloads_total"), F.col("metrics.stars"))
