"""Text, JSON and XML exports."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.scalars import indent_lines, trim_all, xml_escape


def json_rows(df: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    """One JSON object per row; nulls are written, not left out."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return df.select(F.to_json(F.struct("*"), options).alias(name))


def facts(*parts: Column) -> Column:
    """Facts joined by a middle dot; absent ones are skipped."""
    return F.concat_ws(" · ", *parts)


def block(*lines: Column) -> Column:
    """Lines of a text block; absent ones are skipped."""
    return F.concat_ws("\n", *lines)


def list_line(label: str, values: Column) -> Column:
    """``  label: a, b`` if there are values, else null."""
    return F.when(F.size(values) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(values, ", ")))


def indented(text: Column) -> Column:
    """A text's lines, set in; null if it is blank."""
    body = trim_all(text)
    return F.when(body != "", F.array_join(indent_lines(body), "\n"))


def sections(blocks: DataFrame, order: str, heading: str, description: str, rank: str, text: str) -> DataFrame:
    """Rows (section_order, rank, text) that are a document in this order, a row a block, so no section is gathered.

    Rank 0 is a section's ``## heading (n)`` with its description, if any; a block ends in a blank line.
    """
    about = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.col(description), F.lit("\n"))).otherwise("")
    heads = blocks.groupBy(order, heading, description).agg(F.count("*").cast("string").alias("_n"))
    heads = heads.select(F.col(order).alias("section_order"), F.lit(0).cast("long").alias("rank"), F.concat(F.lit("## "), F.col(heading), F.lit(" ("), F.col("_n"), F.lit(")\n"), about, F.lit("\n")).alias("text"))
    return heads.unionByName(blocks.select(F.col(order).alias("section_order"), F.col(rank).cast("long").alias("rank"), F.concat(F.col(text), F.lit("\n\n")).alias("text")))


#: Inline marks: code first, so that nothing inside it is a mark; then links and the emphases.
_CODE, _LINK = r"`([^`]+)`", r"\[([^\[\]]+)\]\(([^()\s]+)\)"
_INLINE = [(r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"~~([^~]+)~~", "<del>$1</del>"), (r"\*([^*]+)\*", "<em>$1</em>")]


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def inline_html(text: Column) -> Column:
    """Inline Markdown as HTML: code, links, strong, emphasis, strikethrough; everything else is escaped."""

    def plain(part: Column) -> Column:
        out = F.regexp_replace(html_escape(part), _LINK, '<a href="$2">$1</a>')
        for pattern, tags in _INLINE:
            out = F.regexp_replace(out, pattern, tags)
        return out

    codes = F.regexp_extract_all(text, F.lit(_CODE), F.lit(1))
    parts = F.split(text, _CODE, -1)
    code = lambda c: F.coalesce(F.concat(F.lit("<code>"), html_escape(c), F.lit("</code>")), F.lit(""))
    return F.array_join(F.zip_with(parts, codes, lambda p, c: F.concat(plain(p), code(c))), "")


def markdown(text: Column) -> Column:
    """Markdown as HTML, a block a line: headings, lists of ``-`` or ``*`` lines, paragraphs, with :func:`inline_html`.

    Blocks are parted by blank lines.  Nested lists, quotes, tables, code blocks and raw HTML
    are not known; their lines are paragraphs.
    """
    lines = lambda b: F.split(b, r"\n")
    item = r"^[-*] +"

    def block(b: Column) -> Column:
        level = F.length(F.regexp_extract(b, r"^(#{1,6}) ", 1)).cast("string")
        listed = F.array_join(F.transform(lines(b), lambda x: F.concat(F.lit("<li>"), inline_html(F.regexp_replace(x, item, "")), F.lit("</li>\n"))), "")
        return (
            F.when(b.rlike(r"^#{1,6} [^\n]*$"), F.concat(F.lit("<h"), level, F.lit(">"), inline_html(F.regexp_replace(b, "^#+ +", "")), F.lit("</h"), level, F.lit(">\n")))
            .when(F.forall(lines(b), lambda x: x.rlike(item)), F.concat(F.lit("<ul>\n"), listed, F.lit("</ul>\n")))
            .otherwise(F.concat(F.lit("<p>"), inline_html(b), F.lit("</p>\n")))
        )

    blocks = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n\s*"), trim_all), lambda b: b != "")
    return F.array_join(F.transform(blocks, block), "")


def page_sections(rows: DataFrame, order: str, heading: str, rank: str, name: str, url: str, body: str) -> DataFrame:
    """Rows (ord, rank, html) of an index page: a heading a section, then an article a row; read in this order they are the page's body."""
    open_ = F.concat(F.lit("<h2>"), html_escape(F.col(heading)), F.lit("</h2>"))
    article = F.concat(F.lit('<article><h3><a href="'), html_escape(F.col(url)), F.lit('">'), html_escape(F.col(name)), F.lit("</a></h3>"), F.col(body), F.lit("</article>"))
    heads = rows.groupBy(order, heading).agg(F.lit(0).cast("long").alias("rank")).select(F.col(order).alias("ord"), "rank", open_.alias("html"))
    return heads.unionByName(rows.select(F.col(order).alias("ord"), F.col(rank).cast("long").alias("rank"), article.alias("html")))


def html_page(sections: DataFrame, title: str, language: str = "en") -> DataFrame:
    """:func:`page_sections` with what makes them a page: the head before, the end behind, a line each."""
    edge = lambda n, html: sections.sparkSession.range(1).select(F.lit(n).cast(sections.schema["ord"].dataType).alias("ord"), F.lit(0).cast("long").alias("rank"), html.alias("html"))
    head = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<head><meta charset="utf-8"><title>'), html_escape(F.lit(title)), F.lit("</title></head>\n<body>"))
    return sections.select("ord", "rank", "html").unionByName(edge(-1, head)).unionByName(edge(2**31 - 1, F.lit("</body>\n</html>")))


def open_sections(sections: DataFrame, key: str, collapsed: list[str], searching: bool) -> DataFrame:
    """Sections with ``is_open``: not among the collapsed ones, or any while a search is active."""
    return sections.withColumn("is_open", F.lit(searching) | ~F.coalesce(F.col(key).isin(*collapsed) if collapsed else F.lit(False), F.lit(False)))


def url_entry(loc: Column, lastmod: Column, priority: Column) -> Column:
    """One ``<url>`` element of a sitemap; ``lastmod`` may be null."""
    tag = lambda name, c: F.concat(F.lit(f"    <{name}>"), xml_escape(c), F.lit(f"</{name}>"))
    return F.concat_ws("\n", F.lit("  <url>"), tag("loc", loc), tag("lastmod", lastmod), tag("priority", priority), F.lit("  </url>"))


def sitemap(entities: DataFrame, stacks: DataFrame, base_url: str, baseline: str, stamp: str = "metrics.updated_at") -> DataFrame:
    """Rows (ord, id, entry): the opening, the home page, every stack but the baseline, the end; in this order a sitemap.

    All pages carry the newest refresh date.
    """
    base = base_url.rstrip("/")
    newest = entities.agg(F.date_format(F.max(F.to_date(F.col(stamp))), "yyyy-MM-dd")).scalar()
    pages = entities.sparkSession.range(1).select(F.lit("").alias("id"), F.lit(0).alias("ord")).unionByName(stacks.where(F.col("id") != baseline).select("id", F.lit(1).alias("ord")))
    loc = F.when(F.col("ord") == 0, F.lit(f"{base}/")).otherwise(F.concat(F.lit(f"{base}/?stack="), F.col("id")))
    priority = F.when(F.col("ord") == 0, F.lit("1.0")).otherwise(F.lit("0.7"))
    entries = pages.select("ord", "id", url_entry(loc, newest, priority).alias("entry"))
    edge = lambda n, text: entities.sparkSession.range(1).select(F.lit(n).alias("ord"), F.lit("").alias("id"), F.lit(text).alias("entry"))
    opening = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return entries.unionByName(edge(-1, opening)).unionByName(edge(2, "</urlset>"))


def tsv_line(*values: Column) -> Column:
    """A tab-separated line: backslash, tab, line feed and carriage return are escaped, nulls are empty, nothing is quoted."""

    def safe(c: Column) -> Column:
        for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(raw), F.lit(escaped))
        return c

    return F.concat_ws("\t", *(F.coalesce(safe(v.cast("string")), F.lit("")) for v in values))


def tsv(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Lines (``line``, with ``ord`` 0 for the header and 1 for rows) of all columns of ``df``, in their order."""
    lines = df.select(F.lit(1).alias("ord"), tsv_line(*(F.col(c) for c in df.columns)).alias("line"))
    if header is None:
        return lines
    return df.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("\t".join(header)).alias("line")).unionByName(lines)


def write_tsv(df: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Tab-separated files as :func:`tsv` makes them; each file starts with the header, if there is one."""
    lines = df.select(tsv_line(*(F.col(c) for c in df.columns)).alias("line"))
    if header is not None:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.withColumn("line", F.when(first, F.concat(F.lit("\t".join(header) + "\n"), "line")).otherwise(F.col("line")))
    lines.write.text(path)


def entity_json(body: Column, fields: dict[str, str], schema: str) -> Column:
    """A JSON document cut to named fields: ``fields`` maps an output name to a path inside ``schema``."""
    parsed = F.from_json(body, schema)

    def at(path: str) -> Column:
        c = parsed
        for part in path.split("."):
            c = c[part]
        return c

    return F.to_json(F.struct(*(at(path).alias(name) for name, path in fields.items())), {"ignoreNullFields": "false"})


def base_url(default: str, variable: str = "BASE_URL") -> str:
    """The site's address: the environment's if it is set, without slashes at its end."""
    return (os.environ.get(variable) or default).rstrip("/")


def stamp_now(now: dt.datetime) -> str:
    """RFC 3339 text of a moment in UTC."""
    return now.astimezone(dt.UTC).isoformat()
