"""Column functions of the catalog: versions, licences, numbers, dates, urls, text.

All are compositions of built-in functions and stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_all(c: Column) -> Column:
    """Strip all white space at both ends; ``trim`` alone strips spaces only."""
    return F.regexp_replace(c, r"^[\s  - 　]+|[\s  - 　]+$", "")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else, for ASCII case-insensitive equality."""
    return F.translate(c, UPPER, LOWER)


def _number(part: Column) -> Column:
    clean = trim_all(part)
    n = F.when(clean.rlike(r"^\+?[0-9]+$"), clean.try_cast("long"))
    return F.coalesce(F.when(n <= 4294967295, n), F.lit(0)).cast("long")


def version_key(version: Column) -> Column:
    """(major, minor, patch) of a dotted version; absent or non-numeric parts are 0."""
    part = lambda i: _number(F.get(F.split(version, r"\."), F.lit(i)))
    return F.when(version.isNotNull(), F.struct(*(part(i).alias(n) for i, n in enumerate(("major", "minor", "patch")))))


def version_numbers(version: Column) -> Column:
    """Every part of a dotted version as a number of any size."""
    part = lambda x: F.coalesce(F.when(trim_all(x).rlike(r"^\+?[0-9]+$"), trim_all(x).try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.transform(F.split(version, r"\."), part)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by number, part by part; missing parts are 0, any number of parts."""
    x, y = version_numbers(a), version_numbers(b)
    pad = lambda v, w: F.concat(v, F.array_repeat(F.lit(0).cast("decimal(38,0)"), F.greatest(F.size(w) - F.size(v), F.lit(0))))
    x2, y2 = pad(x, y), pad(y, x)
    return F.when(x2 < y2, -1).when(x2 > y2, 1).when(x2 == y2, 0)


def license_families(expression: Column) -> Column:
    """Distinct families of an SPDX expression, in order: OR, AND and / part them, version suffixes go."""
    flat = F.replace(F.replace(expression, F.lit(" OR "), F.lit("/")), F.lit(" AND "), F.lit("/"))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(trim_all(x), r"\++$", ""), r"(-or-later)+$", ""), r"(-only)+$", "")
    return F.array_distinct(F.filter(F.transform(F.split(flat, "/", -1), bare), lambda x: x != ""))


def thousands(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def _one_decimal(n: Column, unit: int) -> Column:
    """n / unit with one decimal, rounded as the exact binary quotient is, ties to even.

    At a decimal tie the nearest double decides.  Its distance from the true quotient is
    computed exactly by splitting it in two halves whose products with ``unit`` are exact.
    """
    d = n.cast("double") / float(unit)
    high = d.cast("float").cast("double")
    off = (n.cast("double") - high * float(unit)) - (d - high) * float(unit)
    step = unit // 10
    q, rem = F.floor(n / step).cast("long"), n % step
    q = (n - rem) / step
    q = q.cast("long")
    up = (rem * 2 > step) | ((rem * 2 == step) & ((off < 0) | ((off == 0) & (q % 2 == 1))))
    t = q + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def compact(n: Column) -> Column:
    """1234 as 1.2k and 1234567 as 1.2M; the unit is chosen before rounding (999950 is 1000.0k)."""
    return (
        F.when(n >= 1_000_000, F.concat(_one_decimal(n, 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(_one_decimal(n, 1_000), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def relative_date(then: Column, today: Column) -> Column:
    """today, or Nd, Nw, Nmo, Ny ago."""
    d = F.datediff(today, then)
    by = lambda n, unit: F.concat(F.floor(d / n).cast("int").cast("string"), F.lit(f"{unit} ago"))
    return F.when(d <= 0, "today").when(d < 7, by(1, "d")).when(d < 30, by(7, "w")).when(d < 365, by(30, "mo")).when(d.isNotNull(), by(365, "y"))


def stamp_date(stamp: Column) -> Column:
    """Calendar date of an RFC 3339 stamp in the stamp's own offset; null if it is no such stamp."""
    ok = stamp.rlike(r"^\d{4}-\d\d-\d\d[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    return F.when(ok, F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def relation_name(reference: Column) -> Column:
    """A reference without its parenthesised qualifier."""
    return trim_all(F.substring_index(reference, "(", 1))


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def indent_lines(c: Column) -> Column:
    """Lines of a text, each set in by two spaces; a last line end opens no line."""
    lines = F.split(F.regexp_replace(c, r"\r?\n$", ""), r"\r?\n", -1)
    return F.transform(F.when(c == "", F.array().cast("array<string>")).otherwise(lines), lambda x: F.concat(F.lit("  "), x))


def is_new(added: Column, today: Column, window: int = 30) -> Column:
    """Added within the last ``window`` days; never null, never for the future."""
    return F.coalesce(F.datediff(today, added).between(0, window - 1), F.lit(False))


def flag(c: Column) -> Column:
    """An optional flag: null is false."""
    return F.coalesce(c, F.lit(False))


def relevance(recent: Column, total: Column, stars: Column) -> Column:
    """Recent downloads, else all, else stars, else 0; 0 is a value."""
    return F.coalesce(recent, total, stars, F.lit(0)).cast("long")


def status_label(archived: Column, stale: Column) -> Column:
    return F.when(flag(archived), "Deprecated").when(flag(stale), "Stale").otherwise("Maintained")


def repo_label(url: Column) -> Column:
    for pattern in (r"^(https://)+", r"^(http://)+", r"/+$", r"^github[.]com/"):
        url = F.regexp_replace(url, pattern, "")
    return url


def is_github(url: Column) -> Column:
    return url.rlike(r"^https?://github[.]com/")


def is_gitlab(url: Column) -> Column:
    return url.rlike(r"^https?://gitlab[.]")


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def owner_repo(url: Column) -> Column:
    """First two path segments of a repository url, the second without ``.git``; null without both."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(0)).alias("owner"), F.regexp_replace(F.get(parts, F.lit(1)), r"([.]git)+$", "").alias("repo")))


def install_crate(installable: Column, crate: Column, metrics_crate: Column) -> Column:
    return F.when(installable, F.coalesce(crate, metrics_crate))


def haystack(*columns: Column) -> Column:
    """Lower-cased fields joined by single spaces, for keyword filters; nulls are empty."""
    parts = [p for c in columns for p in (F.lit(" "), F.coalesce(c, F.lit("")))][1:]
    return F.lower(F.concat(*parts))


def null_if(c: Column, sentinel: str) -> Column:
    return F.nullif(c, F.lit(sentinel))


def saturate(c: Column) -> Column:
    """A wide decimal as a long, capped at the largest long."""
    return F.least(c, F.lit(9223372036854775807).cast("decimal(38,0)")).cast("long")


def short_line(c: Column, width: int = 80) -> Column:
    """One line of at most ``width`` characters: line ends and tabs become spaces."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\t]", " "), 1, width)
