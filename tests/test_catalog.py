"""A small catalog of its own, end to end: load, checks, grouping, search, filters, exports, refresh."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catalith.operators import relations
from catalith.plans.catalog import Catalog
from catalith.plans.spec import FilterSpec
from catalith.sources import captured, toml

CATEGORIES = """
[[category]]
id = "test"
name = "Testing"
description = "Run tests."
[[category]]
id = "empty"
name = "Nothing"
[[category]]
id = "build"
name = "Building"
"""
ENTITIES = {
    "alpha": """
id = "alpha"
name = "Alpha"
repository = "https://github.com/x/alpha"
category = "test"
crate = "alpha"
remarks = \"\"\"
Runs fuzz tests.
Fast.
\"\"\"
alternatives = ["BETA (old)", "none of these"]
added = "2024-02-20"
[metrics]
stars = 10
last_commit = "2024-02-28"
license = "MIT"
updated_at = "2024-02-28T03:36:46.801146060+00:00"
[metrics.crate]
name = "alpha"
downloads_total = 1250
downloads_recent = 0
msrv = "1.74"
license = "MIT OR Apache-2.0"
""",
    "beta": """
id = "beta"
name = "Beta"
repository = "https://gitlab.com/x/beta"
category = "test"
recommended = true
[metrics]
stars = 5
archived = true
""",
    "gamma": """
id = "gamma"
name = "Gamma"
repository = "https://example.org/gamma"
category = "test"
recommended = true
installable = false
[metrics.crate]
name = "gamma"
msrv = "1.74.0"
""",
    "delta": """
id = "delta"
name = "Delta"
repository = "https://codeberg.org/x/delta"
category = "build"
""",
}
STACKS = {
    "essentials": """
id = "essentials"
name = "Essentials"
[[pick]]
tool = "delta"
note = "Always."
""",
    "web": """
id = "web"
name = "Web"
[[picks]]
tool = "alpha"
note = "first"
[[picks]]
tool = "alpha"
note = "again"
[[picks]]
tool = "gamma"
""",
}
def today():
    return F.lit(dt.date(2024, 3, 1))


def write(folder, entities=ENTITIES, stacks=STACKS):
    (folder / "entities").mkdir()
    for k, v in entities.items():
        (folder / "entities" / f"{k}.toml").write_text(v)
    if stacks is not None:
        (folder / "stacks").mkdir()
        for k, v in stacks.items():
            (folder / "stacks" / f"{k}.toml").write_text(v)
    (folder / "categories.toml").write_text(CATEGORIES)
    (folder / "entities" / "notes.txt").write_text("not an entity")
    return str(folder)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    return Catalog.load(spark, write(tmp_path_factory.mktemp("catalog")))


def test_load(catalog):
    rows = {r["id"]: r for r in catalog.entities.collect()}
    assert set(rows) == set(ENTITIES)
    assert rows["delta"]["installable"] is True and rows["delta"]["alternatives"] == [] and rows["delta"]["metrics"] is None
    m = rows["alpha"]["metrics"]
    assert m["updated_at_raw"].endswith("801146060+00:00") and m["updated_at"].microsecond == 801146 and m["archived"] is False and m["crate"]["owners"] == []
    assert [tuple(r) for r in catalog.categories.orderBy("ord").select("ord", "id", "description").collect()] == [(0, "test", "Run tests."), (1, "empty", ""), (2, "build", "")]


def test_grouping_omits_empty_and_sinks_archived(catalog):
    got = [tuple(r) for r in catalog.grouped().orderBy("position").select("category", "id", "rank", "position").collect()]
    assert got == [("test", "gamma", 1, 0), ("test", "alpha", 2, 1), ("test", "beta", 3, 2), ("build", "delta", 1, 3)]


def test_unknown_category_and_pick_are_rejected(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    with pytest.raises(ValueError, match="unknown category"):
        Catalog.load(spark, write(tmp_path / "a", {"x": ENTITIES["delta"].replace('"build"', '"nowhere"')}, None))
    with pytest.raises(ValueError, match="unknown pick"):
        Catalog.load(spark, write(tmp_path / "b", {"alpha": ENTITIES["alpha"]}, {"s": 'id = "s"\nname = "S"\n[[pick]]\ntool = "ghost"\n'}))


def test_duplicates_are_rejected_and_stacks_may_be_missing(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate entity"):
        Catalog.load(spark, write(tmp_path, ENTITIES | {"copy": ENTITIES["delta"]}, None))


def test_required_keys(spark, tmp_path):
    (tmp_path / "x.toml").write_text('id = "x"')
    with pytest.raises(Exception, match="entity has no name"):
        toml.read_entities(spark, str(tmp_path)).collect()


def test_search(catalog):
    ids = lambda q: [r["id"] for r in catalog.search(q).collect()]
    assert ids("  FUZZ ") == ["alpha"] and ids("") == [] and ids("test") == ["alpha", "gamma", "beta"] and ids("none of") == ["alpha"]


def test_relations(catalog):
    rows = {r["id"]: [tuple(x) for x in r["alternatives"]] for r in catalog.relations("alternatives").collect()}
    assert rows["alpha"] == [("BETA (old)", "beta"), ("none of these", None)] and rows["beta"] == []


def test_memberships_and_cards(catalog):
    rows = {r["tool"]: r for r in catalog.memberships().collect()}
    assert [tuple(x) for x in rows["alpha"]["stacks"]] == [("web", "first")] and rows["delta"]["baseline_note"] == "Always."
    card = catalog.stack_cards().first()
    assert (card["id"], card["n_picks"], card["install_crates"], card["uncovered"]) == ("web", 3, ["alpha", "alpha"], ["Gamma"])
    assert [tuple(r) for r in catalog.baseline_layer().collect()] == [(0, "delta", "Delta", None)]


def test_view(catalog):
    rows = {r["id"]: r for r in catalog.view(today()).collect()}
    a = rows["alpha"]
    assert (a["downloads"], a["downloads_label"], a["downloads_total_label"], a["is_new"], a["last_activity"]) == (0, "0", "1,250", True, "2d ago")
    assert a["license_token_text"] == "mit apache-2.0" and a["haystack"].startswith("alpha alpha runs fuzz") and a["install_command"] == "cargo install alpha"
    assert rows["gamma"]["install_command"] is None and rows["beta"]["status"] == "Deprecated" and rows["delta"]["sort_added"] == ""


@pytest.mark.parametrize(
    ("url", "ids", "active"),
    [
        ("/?q=fast%20RUNS", ["alpha"], 0),
        ("/?deprecated=0", ["gamma", "alpha", "delta"], 1),
        ("/?recommended=1&sort=name", ["beta", "gamma"], 2),
        ("/?license=mit", ["alpha"], 1),
        ("/?msrv=1.74", ["gamma", "alpha"], 1),
        ("/?stack=web&sort=stars", ["alpha", "gamma", "delta"], 2),
        ("/?sort=nonsense", ["gamma", "alpha", "beta", "delta"], 0),
    ],
)
def test_browse(catalog, url, ids, active):
    spec = FilterSpec.from_url(url)
    assert spec.active_count() == active
    assert FilterSpec.from_url("/?" + spec.to_query_string()) == spec
    assert [r["id"] for r in catalog.browse(spec, today()).collect()] == ids
    counts = {r["category"]: r["n"] for r in catalog.category_counts(spec, today()).collect()}
    assert sum(counts.values()) == len(ids) and counts["empty"] == 0


def test_marks(catalog):
    rows = {r["id"]: (r["is_pick"], r["is_baseline"]) for r in catalog.browse(FilterSpec(stack="web"), today()).collect()}
    assert rows == {"alpha": (True, False), "gamma": (True, False), "delta": (False, True)}


def test_facets(catalog):
    assert [tuple(r) for r in catalog.license_options().collect()] == [("apache-2.0", "Apache-2.0"), ("mit", "MIT")]
    assert [r["version"] for r in catalog.msrv_options().collect()] == ["1.74", "1.74.0"]
    assert {(r["category"], r["n"], r["is_total"], r["n_groups"]) for r in catalog.totals().collect()} == {("test", 3, False, 1), ("build", 1, False, 1), (None, 4, True, 2)}
    assert FilterSpec.from_url("/?license=gpl", licenses={"mit"}).license == ""


def test_text_export(catalog):
    first = "".join(r["text"] for r in catalog.text_export().collect())
    assert first.startswith("## Testing (3)\nRun tests.\n\n- Gamma [RECOMMENDED]: https://example.org/gamma\n  Rust 1.74.0+\n\n- Alpha: https://github.com/x/alpha\n  1250 downloads · Rust 1.74+ · 10 stars · last commit 2024-02-28 · MIT\n  Runs fuzz tests.\n  Fast.\n  alternatives: BETA (old), none of these\n\n- Beta [RECOMMENDED] [DEPRECATED]")
    assert catalog.text_header("Entities", "About.").first()["text"] == "# Entities\nAbout.\n4 entities across 2 categories."


def test_sitemap_and_json(catalog):
    rows = [r["entry"] for r in catalog.sitemap("https://e.org/").collect()]
    assert rows[1] == "  <url>\n    <loc>https://e.org/</loc>\n    <lastmod>2024-02-28</lastmod>\n    <priority>1.0</priority>\n  </url>"
    assert len(rows) == 4 and "?stack=web" in rows[2] and rows[3] == "</urlset>"
    assert json.loads(catalog.sample("zeta").first()[0])["homepage"] is None


def test_refresh(spark, catalog):
    body = json.dumps({"stargazers_count": 99, "forks_count": 1, "open_issues_count": 2, "pushed_at": "2024-03-01T23:00:00-08:00", "archived": False, "license": {"spdx_id": "NOASSERTION"}})
    crate = json.dumps({"crate": {"downloads": 7, "recent_downloads": 3, "newest_version": "2.0"}, "versions": [{"num": "1.0"}, {"num": "2.0", "rust_version": "1.80", "created_at": "2024-01-05T00:00:00Z"}]})
    rows = [("alpha", "github.com", body, None), ("alpha", "registry", crate, None), ("alpha", "owners", json.dumps({"users": [{"login": "l"}, {"login": "m", "name": "M"}, {}]}), None), ("beta", "gitlab.com", None, "timeout"), ("delta", "codeberg.org", json.dumps({"stars_count": 3}), None)]
    responses = spark.createDataFrame(rows, "id string, kind string, body string, error string")
    out = captured.outcomes(catalog.entities, responses)
    fresh = out.select("id", "failure", toml.metrics_struct("forge", "registry", F.lit("2024-03-02T00:00:00Z")).alias("new_metrics"))
    new = {r["id"]: r["metrics"] for r in relations.upsert_metrics(catalog.entities, fresh).collect()}
    assert new["alpha"]["stars"] == 99 and new["alpha"]["license"] is None and new["alpha"]["last_commit"] == dt.date(2024, 3, 1)
    assert new["alpha"]["crate"]["msrv"] == "1.80" and new["alpha"]["crate"]["owners"] == ["l", "M"] and new["alpha"]["crate"]["downloads_recent"] == 3
    assert new["beta"]["stale"] is True and new["beta"]["error"] == "timeout" and new["beta"]["stars"] == 5
    assert new["delta"]["stars"] == 3 and new["gamma"]["stars"] is None and new["gamma"]["archived"] is False


def test_stream_equals_batch(spark, catalog, tmp_path):
    from catalith.streaming.refresh import apply_outcomes

    entities = catalog.entities.select("id", "metrics")
    entities.write.parquet(f"{tmp_path}/t/v=0")
    at = [("alpha", None, "late", 2), ("alpha", None, None, 1)]
    kind = entities.schema["metrics"].dataType.simpleString()
    spark.createDataFrame(at, f"id string, new_metrics {kind}, failure string, at int").write.parquet(f"{tmp_path}/in")
    q = apply_outcomes(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination()
    row = spark.read.parquet(f"{tmp_path}/t/v=1").where("id = 'alpha'").first()["metrics"]
    assert row["stale"] and row["error"] == "late" and row["stars"] == 10
    # an outcome that is older than what the table shows changes nothing; a newer one does; older versions go
    later = [("alpha", None, "older", 1), ("beta", None, "first", 1)]
    spark.createDataFrame(later, f"id string, new_metrics {kind}, failure string, at int").write.mode("append").parquet(f"{tmp_path}/in")
    apply_outcomes(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    last = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/t/v=2").collect()}
    assert last["alpha"]["metrics"]["error"] == "late" and last["beta"]["metrics"]["error"] == "first" and last["alpha"]["outcome_at"] == 2
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=1", "v=2"]


def test_unusable_responses_are_failures(spark):
    rows = [("a", "github.com", "<html>rate limited</html>", None, 200), ("b", "github.com", '{"message": "Not Found"}', None, 404), ("c", "github.com", '{"stargazers_count": "many"}', None, None), ("d", "github.com", '[{"stargazers_count": 1}]', None, None), ("e", "github.com", None, None, None), ("f", "github.com", '{"stargazers_count": 3, "extra": {}}', None, 200), ("g", "github.com", "{}", "timed out", None)]
    responses = spark.createDataFrame(rows, "id string, kind string, body string, error string, status int")
    entities = spark.createDataFrame([(k, None, f"https://github.com/x/{k}") for k in "abcdefgh"], "id string, crate string, repository string")
    got = {r["id"]: (r["failure"], r["forge"]) for r in captured.outcomes(entities, responses).collect()}
    bad = captured.UNREADABLE
    assert {k: f for k, (f, _) in got.items()} == {"a": bad, "b": "status 404", "c": bad, "d": bad, "e": bad, "f": None, "g": "timed out", "h": captured.MISSING}
    assert got["f"][1]["stars"] == 3 and all(v is None for k, (_, v) in got.items() if k != "f")


def test_tsv(spark, tmp_path):
    from catalith.operators import export

    df = spark.createDataFrame([(" a", None, 'q"u'), ("b\tc", "", "x\\y\nz")], "n string, e string, v string").coalesce(1)
    export.write_tsv(df, f"file://{tmp_path}/t", ["n", "e", "v"])
    (part,) = [p for p in (tmp_path / "t").iterdir() if p.name.endswith(".txt")]
    assert part.read_text() == 'n\te\tv\n a\t\tq"u\nb\\tc\t\tx\\\\y\\nz\n'
    assert [r.line for r in export.tsv(df, ["n", "e", "v"]).orderBy("ord").collect()][0] == "n\te\tv"


def test_write_back_keeps_everything_else(spark):
    text = 'id = "x"  # mine\n\n[metrics]\nstars = 1\n# of the table\n[metrics.crate]\nname = "c"\n[[pick]]\nentity = "y"\n'
    rows = [(text,), ('id = "x"',), ("",), ('[metrics]\nstars = 1',)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(toml.replace_table(F.col("t"), "metrics", F.lit("stars = 2\n")).alias("t")).collect()]
    new = "[metrics]\nstars = 2\n"
    assert got == ['id = "x"  # mine\n\n' + new + '[[pick]]\nentity = "y"\n', 'id = "x"\n' + new, new, new]
    line = spark.range(1).select(toml.table_lines(F.struct(F.lit('a"b').alias("s"), F.lit(1.5).alias("n"), F.lit("2024-01-01").cast("date").alias("d")), ["s", "n", "d"]).alias("t")).first()["t"]
    assert line == 's = "a\\"b"\nn = 1.5\nd = "2024-01-01"\n'


def test_base_url(monkeypatch):
    from catalith.operators import export

    assert export.base_url("https://a.org//") == "https://a.org"
    monkeypatch.setenv("BASE_URL", "https://b.org/")
    assert export.base_url("https://a.org") == "https://b.org"
