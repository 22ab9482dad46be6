"""Captured responses of code forges and of a package registry.

There are no live calls: responses are JSON documents that some fetcher stored, one per
line, with the entity's id.  A body is parsed once, to a variant, and projected to one normal
form by declared paths and types.  A response that reports an error, can't be decoded, has no success status or never
came gives an error column, not a failed job and not a row of nulls.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.scalars import null_if, owner_repo, short_line, stamp_date, url_host
from catalith.operators.ranking import newest_version, rank_in_group

FORGE_COLUMNS = ["stars", "forks", "open_issues", "last_commit", "archived", "license"]
#: Fields of a forge's response, by exact host of the repository: column, path, type.
FORGES: dict[str, dict[str, tuple[str, str]]] = {
    "github.com": {"stars": ("$.stargazers_count", "long"), "forks": ("$.forks_count", "long"), "open_issues": ("$.open_issues_count", "long"), "at": ("$.pushed_at", "string"), "archived": ("$.archived", "boolean"), "license": ("$.license.spdx_id", "string")},
    "gitlab.com": {"stars": ("$.star_count", "long"), "forks": ("$.forks_count", "long"), "open_issues": ("$.open_issues_count", "long"), "at": ("$.last_activity_at", "string"), "archived": ("$.archived", "boolean"), "license": ("$.license.nickname", "string"), "license_name": ("$.license.name", "string")},
    "codeberg.org": {"stars": ("$.stars_count", "long"), "forks": ("$.forks_count", "long"), "open_issues": ("$.open_issues_count", "long"), "at": ("$.updated_at", "string"), "archived": ("$.archived", "boolean")},
}
REGISTRY = {
    "downloads": ("$.crate.downloads", "long"), "recent": ("$.crate.recent_downloads", "long"), "newest": ("$.crate.newest_version", "string"),
    "versions": ("$.versions", "array<struct<num: string, created_at: string, license: string, rust_version: string>>"), "crate": ("$.crate", "object"),
}
OWNERS = {"users": ("$.users", "array<struct<login: string, name: string>>")}
PACKAGES = {"crates": ("$.crates", "array<struct<name: string, recent_downloads: long, max_stable_version: string, newest_version: string, description: string>>")}
_PACKAGE = PACKAGES["crates"][1].removeprefix("array<").removesuffix(">")
_NAMES = ("name", "recent_downloads", "max_stable_version", "newest_version", "description")
#: What a value's own type has to be where a type is asked for; for others a cast decides.
_OWN = {"long": "BIGINT", "boolean": "BOOLEAN"}


#: What any unusable response is called; a reported error keeps its own text.
MISSING, UNREADABLE = "no response", "cannot decode the response"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses: id, kind (a host, ``registry`` or ``owners``), body, error, status (null: not recorded)."""
    return spark.read.schema("id string, kind string, body string, error string, status int").json(path)


def parsed(responses: DataFrame) -> DataFrame:
    """``responses`` with ``_v``, the body as a variant: parsed once, whatever its kind; null if it isn't one JSON object.

    A key that a body holds twice makes it unreadable.
    """
    body = F.when(F.trim("body").startswith("{"), F.try_parse_json("body"))
    return responses.withColumn("_v", body)


def _field(path: str, kind: str) -> tuple[Column, Column]:
    """A field of ``_v`` and whether it is there with another type."""
    raw = F.try_variant_get("_v", path, "variant")
    given = raw.isNotNull() & ~F.is_variant_null(raw)
    own = F.schema_of_variant(raw)
    if kind == "object":
        return F.when(given, F.lit(True)), given & ~own.startswith("OBJECT")
    value = F.try_variant_get("_v", path, kind)
    wrong = own != _OWN[kind] if kind in _OWN else value.isNull()
    return value, F.coalesce(given & wrong, F.lit(False))


def fields(spec: dict[str, tuple[str, str]], required: str | None = None) -> tuple[dict[str, Column], Column]:
    """The fields of ``_v`` by name, and whether the body can't be used: other fields are free, these have their types."""
    found = {name: _field(*where) for name, where in spec.items()}
    bad = reduce(or_, (wrong for _, wrong in found.values()), F.col("_v").isNull())
    values = {name: value for name, (value, _) in found.items()}
    return values, bad | values[required].isNull() if required else bad


def _failure(responses: DataFrame, bad: Column) -> Column:
    """The error of a response: reported, of its status, or of its body."""
    status = F.col("status") if "status" in responses.columns else F.lit(None).cast("int")
    return F.coalesce(F.col("error"), F.when(~status.between(200, 299), F.concat(F.lit("status "), status.cast("string"))), F.when(F.coalesce(bad, F.lit(True)), F.lit(UNREADABLE)))


def fetch_schedule(entities: DataFrame, order: str = "id", pause_ms: int = 250) -> DataFrame:
    """Entities with ``not_before_ms``: when a fetcher may ask for each, one after the other with a pause between.

    There is no live fetcher here; this is the plan that one keeps to.
    """
    placed = rank_in_group(entities.withColumn("_all", F.lit(0)), "_all", [F.asc(order)], "_place")
    return placed.withColumn("not_before_ms", (F.col("_place") - 1) * pause_ms).drop("_all", "_place")


def route(entities: DataFrame) -> DataFrame:
    """Entities with ``host`` (null if no source serves it), owner, repo and ``failure`` for an unusable url."""
    host = url_host(F.col("repository"))
    known = F.when(host.isin(*FORGES), host)
    return entities.withColumns({"host": known, "_or": owner_repo(F.col("repository"))}).withColumns(
        {"owner": F.col("_or.owner"), "repo": F.col("_or.repo"), "failure": F.when(known.isNotNull() & F.col("_or").isNull(), F.lit("cannot parse owner and repository"))}
    ).drop("_or")


def _forge(host: str, f: dict[str, Column]) -> Column:
    """A forge's response in the common form."""
    none = F.lit(None).cast("string")
    licence = {"github.com": lambda: null_if(f["license"], "NOASSERTION"), "gitlab.com": lambda: F.coalesce(f["license"], f["license_name"])}.get(host, lambda: none)()
    values = {"stars": f["stars"], "forks": f["forks"], "open_issues": f["open_issues"], "last_commit": stamp_date(f["at"]), "archived": F.coalesce(f["archived"], F.lit(False)), "license": licence}
    return F.struct(*(values[k].alias(k) for k in FORGE_COLUMNS))


def owner_names(users: Column) -> Column:
    """Names, else logins; users with neither drop out."""
    return F.filter(F.transform(users, lambda u: F.coalesce(u["name"], u["login"])), lambda x: x.isNotNull())


def _crate(f: dict[str, Column]) -> Column:
    version = newest_version(f["versions"], f["newest"])
    return F.struct(
        F.col("id").alias("name"),
        f["downloads"].alias("downloads_total"),
        f["recent"].alias("downloads_recent"),
        f["newest"].alias("latest_version"),
        stamp_date(version["created_at"]).alias("latest_release"),
        version["rust_version"].alias("msrv"),
        version["license"].alias("license"),
    )


def normal_responses(responses: DataFrame) -> DataFrame:
    """A row per id: (id, forge, forge_error, registry, registry_error) of all kinds of responses, read in one pass.

    Owners are best effort and default to none.  Of repeated responses of a kind a usable one counts
    before an error, and then the greatest.
    """
    of = lambda wanted, value: F.when(F.col("kind") == wanted, value)
    rows = parsed(responses)
    forges, forge_errors = [], []
    for host, spec in FORGES.items():
        values, bad = fields(spec)
        forges.append(of(host, _forge(host, values)))
        forge_errors.append(of(host, F.coalesce(bad, F.lit(True))))
    crate, no_crate = fields(REGISTRY, "crate")
    users, no_users = fields(OWNERS)
    bad = F.coalesce(*forge_errors, of("registry", F.coalesce(no_crate, F.lit(True))), of("owners", F.coalesce(no_users, F.lit(True))))
    read = rows.select("id", "kind", _failure(responses, bad).alias("_error"), F.coalesce(*forges).alias("_forge"), of("registry", _crate(crate)).alias("_crate"), of("owners", owner_names(users["users"])).alias("_users"))
    good, is_forge = F.col("_error").isNull(), F.col("kind").isin(*FORGES)

    def best(mine: Column, value: str) -> Column:
        """The best of an id's responses of a kind: (usable, value, error)."""
        return F.max(F.when(mine, F.struct(good.alias("ok"), F.when(good, F.col(value)).alias("value"), F.col("_error").alias("error"))))

    one = read.groupBy("id").agg(best(is_forge, "_forge").alias("f"), best(F.col("kind") == "registry", "_crate").alias("r"), best(F.col("kind") == "owners", "_users").alias("o"))
    owners = F.coalesce("o.value", F.array().cast("array<string>"))
    names = ("name", "downloads_total", "downloads_recent", "latest_version", "latest_release", "msrv", "license")
    registry = F.when(F.col("r.ok"), F.struct(*(F.col(f"r.value.{n}").alias(n) for n in names), owners.alias("owners")))
    return one.select("id", F.col("f.value").alias("forge"), F.col("f.error").alias("forge_error"), registry.alias("registry"), F.col("r.error").alias("registry_error"))


def outcomes(entities: DataFrame, responses: DataFrame) -> DataFrame:
    """Refresh outcomes (id, forge, registry, failure): a registry failure fails the entity even if its forge answered."""
    routed = route(entities).select("id", "crate", "host", F.col("failure").alias("_bad"))
    joined = routed.join(normal_responses(responses), "id", "left")
    wants = F.col("crate").isNotNull()
    lacks = lambda value, error: F.coalesce(F.col(error), F.when(F.col(value).isNull(), F.lit(MISSING)))
    failure = F.coalesce("_bad", F.when(F.col("host").isNotNull(), lacks("forge", "forge_error")), F.when(wants, lacks("registry", "registry_error")))
    return joined.select("id", F.when(F.col("host").isNotNull(), F.col("forge")).alias("forge"), F.when(wants, F.struct(F.col("crate").alias("name"), *(F.col(f"registry.{n}").alias(n) for n in ("downloads_total", "downloads_recent", "latest_version", "latest_release", "msrv", "license", "owners")))).alias("registry"), failure.alias("failure"))


def read_pages(pages: DataFrame, pages_wanted: int | None = None) -> DataFrame:
    """Packages of stored pages (page, body, error, status) of a keyword scan, up to page ``pages_wanted``.

    A page that can't be used is a row of its own, with ``page_error`` and nothing else; other rows have none.
    """
    kept = parsed(pages if pages_wanted is None else pages.where(F.col("page") <= pages_wanted))
    values, bad = fields(PACKAGES, "crates")
    read = kept.select("page", _failure(pages, bad).alias("page_error"), values["crates"].alias("_crates")).where("page_error IS NOT NULL OR size(_crates) > 0")
    return read.select("page", "page_error", F.inline(F.when(F.col("page_error").isNull(), F.col("_crates")).otherwise(F.array(F.struct(*(F.lit(None).alias(n) for n in _NAMES)).cast(_PACKAGE)))))


def listing(packages: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of a keyword scan's listing: name, recent, version, description.

    A page that couldn't be read stops a strict scan; otherwise it is left to the caller, who
    has ``page_error`` in :func:`read_pages`.
    """
    if strict:
        bad = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), F.col("page_error"))
        packages = packages.where(F.col("page_error").isNull() | F.raise_error(bad).cast("boolean"))
    else:
        packages = packages.where("page_error IS NULL")
    return packages.select("name", F.coalesce("recent_downloads", F.lit(0)).alias("recent"), F.coalesce("max_stable_version", "newest_version", F.lit("")).alias("version"), short_line(F.col("description")).alias("description"))


def discover(packages: DataFrame, limit: int, offset: int = 0, strict: bool = True) -> DataFrame:
    """Keyword-scan listing: most recent downloads first, one page; the limit is the feature."""
    return listing(packages, strict).orderBy(F.desc("recent"), "name").offset(offset).limit(limit)
