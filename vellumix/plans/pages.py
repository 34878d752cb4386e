"""Queries on web pages: titles, metadata, content, names, front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellumix.functions import text as t, web
from vellumix.functions.frontmatter import built, parse_column
from vellumix.operators import extraction, library, planning
from vellumix.plans.registry import Sql, query, table

FALLBACK_TITLE = "untitled"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


_TITLE = f"coalesce(nullif({Sql.element('html', 'h1')}, ''), nullif({Sql.element('html', 'title')}, ''), 'untitled')"
_LANG = Sql.squeeze(Sql.one("html", r"""(?is)<html\b[^>]*?[\s"']lang\s*=\s*["']?([^\s"'>]*)"""))
_ARTICLE = Sql.one("html", r"(?is)<article\b[^>]*>(.*)</article\s*>")
_BODY = Sql.strip_html(_ARTICLE)


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", web.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {Sql.host('url')} AS host, {Sql.host('url')} IN ('zhihu.com') OR {Sql.host('url')} LIKE '%.zhihu.com' AS known FROM pages")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = web.host("url")
    return _pages(spark, sf_dir).select("page_id", host.alias("host"), web.host_within(host, "zhihu.com").alias("known"))


@query(f"SELECT page_id, {_LANG} AS lang FROM pages")
def page_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", web.language(F.col("html")).alias("lang"))


@query(f"SELECT page_id, {Sql.host('url')} AS site_name, '' AS author, '' AS excerpt, {_LANG} AS lang FROM pages")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return _pages(spark, sf_dir).select("page_id", web.site_name(html, F.col("url")).alias("site_name"), web.author(html).alias("author"), web.description(html).alias("excerpt"), web.language(html).alias("lang"))


@query(f"SELECT page_id, {_BODY} AS body, 'fallback:article' AS extraction FROM pages")
def page_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, label = web.fallback_content(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", t.strip_html(content).alias("body"), label.alias("extraction"))


@query(f"SELECT page_id, {Sql.words(_BODY)} AS words, {Sql.truncate(Sql.squeeze(_BODY))} AS excerpt FROM pages")
def page_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = t.strip_html(web.fallback_content(F.col("html"))[0])
    return _pages(spark, sf_dir).select("page_id", t.count_words(body).alias("words"), t.truncate(t.squeeze(body)).alias("excerpt"))


@query(f"""SELECT page_id, url, {Sql.host('url')} AS host, {_TITLE} AS title, {_LANG} AS lang, 'fallback:article' AS extraction,
{Sql.normalize(_BODY)} AS body, {Sql.words(Sql.normalize(_BODY))} AS word_count, {Sql.truncate(Sql.squeeze(_BODY))} AS excerpt, length({Sql.normalize(_BODY)}) > 50000 AS truncated FROM pages""")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every page as a clean article with its metadata."""
    html = F.col("html")
    content, label = web.fallback_content(html)
    text = t.strip_html(content)
    rows = _pages(spark, sf_dir).select("page_id", "url", web.host("url").alias("host"), web.title(html).alias("title"), web.language(html).alias("lang"), label.alias("extraction"), t.normalize_markdown(text).alias("body"), t.truncate(t.squeeze(text)).alias("excerpt"))
    return rows.withColumns({"word_count": t.count_words(F.col("body")), "truncated": F.length("body") > 50_000})


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\b')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<script\\b')) AS BIGINT) AS scripts,
CAST(len(regexp_extract_all(html, '(?i)<style\\b')) AS BIGINT) AS styles, CAST(len(regexp_extract_all(html, '(?i)<(?:iframe|object|embed|form)\\b')) AS BIGINT) AS embeds, CAST(len(regexp_extract_all(html, '(?is)<!--.*?-->')) AS BIGINT) AS comments FROM pages""")
def page_removed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _pages(spark, sf_dir).select("page_id", n(r"(?i)<a\b").alias("links"), n(r"(?i)<script\b").alias("scripts"), n(r"(?i)<style\b").alias("styles"), n(r"(?i)<(?:iframe|object|embed|form)\b").alias("embeds"), n(r"(?is)<!--.*?-->").alias("comments"))


@query(f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all({Sql.re("html", ("(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>", ""), ("(?s)<!--.*?-->", ""))}, '(?is)<h1\\b[^>]*>.*?</h1\\s*>|<h2\\b[^>]*>.*?</h2\\s*>|<h3\\b[^>]*>.*?</h3\\s*>|<h4\\b[^>]*>.*?</h4\\s*>|<h5\\b[^>]*>.*?</h5\\s*>|<h6\\b[^>]*>.*?</h6\\s*>')) AS h FROM pages)
SELECT page_id, CAST(substr(h, 3, 1) AS INT) AS level, {Sql.squeeze(Sql.re("h", ("<[^>]*>", "")))} AS title FROM h""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = t.strip_comments(t.replaced(F.col("html"), (r"(?is)<(script|style|template)\b.*?</\1\s*>", "")))
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1\s*>"), F.lit(0))
    rows = _pages(spark, sf_dir).select("page_id", F.explode(found).alias("h"))
    return rows.select("page_id", F.substring("h", 3, 1).cast("int").alias("level"), t.squeeze(t.strip_tags(F.col("h"))).alias("title"))


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<[a-z][a-z0-9]*\\b[^>]*?\\sclass\\s*=\\s*"([^"]*)"', 1)) AS v FROM pages),
k AS (SELECT page_id, v, [x FOR x IN regexp_split_to_array(lower(regexp_replace(v, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') IF x <> ''] AS k FROM c)
SELECT page_id, v AS value, array_to_string(k, ' ') AS tokens, list_has_any(k, ['share', 'sharing', 'advert', 'advertisement', 'sponsor', 'promotion', 'comment', 'comments', 'related', 'toc', 'pager', 'pagination'])
 OR (list_contains(k, 'ad') AND list_has_any(k, ['banner', 'slot', 'wrap'])) AS noise FROM k""")
def page_noise_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.regexp_extract_all("html", F.lit(r'(?is)<[a-z][a-z0-9]*\b[^>]*?\sclass\s*=\s*"([^"]*)"'), F.lit(1))
    rows = _pages(spark, sf_dir).select("page_id", F.explode(values).alias("value")).withColumn("k", web.attribute_tokens(F.col("value")))
    has = lambda *ts: F.arrays_overlap("k", F.array(*[F.lit(x) for x in ts]))
    noise = has("share", "sharing", "advert", "advertisement", "sponsor", "promotion", "comment", "comments", "related", "toc", "pager", "pagination") | (has("ad") & has("banner", "slot", "wrap"))
    return rows.select("page_id", "value", F.array_join("k", " ").alias("tokens"), noise.alias("noise"))


@query(f"SELECT page_id, {Sql.folder(_TITLE)} AS name FROM pages")
def page_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", t.folder_name(web.title(F.col("html"))).alias("name"))


@query(f"""WITH n AS (SELECT page_id, {Sql.host('url')} AS name FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM n)
SELECT page_id AS ord, name, CASE WHEN k = 1 THEN name ELSE name || ' (' || CAST(k AS VARCHAR) || ')' END AS final_name FROM r""")
def page_name_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names of pages named by host: repeats get (2), (3), ..."""
    inputs = _pages(spark, sf_dir).select(F.col("page_id").alias("ord"), web.host("url").alias("name"), F.lit(None).cast("string").alias("source_ext"), F.lit("").alias("slot"))
    return library.registered_names(inputs)


@query(f"""WITH u AS (SELECT page_id, {Sql.squeeze('url')} AS url FROM pages UNION ALL SELECT page_id, 'ftp' || substr({Sql.squeeze('url')}, 5) FROM pages WHERE page_id % 10 = 0)
SELECT CAST(0 AS INT) AS src, url, CASE WHEN NOT regexp_matches(url, '(?i)\\Ahttps?://') THEN 'scheme' ELSE 'ok' END AS status FROM u""")
def page_url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    texts = pages.select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("\r\n\n  ftp"), F.expr("substring(url, 5)"), F.lit("\n"))).otherwise(F.lit("\n\n"))).alias("text"))
    return planning.url_lines(texts, "page_id", "text").select(F.lit(0).alias("src"), "url", "status")


_QUOTE = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


@query(f"""SELECT page_id, '---' || chr(10) || 'title: ' || {_QUOTE.format(_TITLE)} || chr(10) || 'source: ' || {_QUOTE.format('url')} || chr(10) || 'siteName: ' || {_QUOTE.format(Sql.host('url'))} || chr(10) ||
CASE WHEN {_LANG} <> '' THEN 'lang: ' || {_QUOTE.format(_LANG)} || chr(10) ELSE '' END || 'wordCount: ' || CAST({Sql.words(_BODY)} AS VARCHAR) || chr(10) || 'extraction: "fallback:article"' || chr(10) || 'convertedAt: "2026-01-01T00:00:00.000Z"' || chr(10) || '---' || chr(10) AS front_matter FROM pages""")
def page_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    content, label = web.fallback_content(html)
    fields = {"title": web.title(html), "source": F.col("url"), "siteName": web.site_name(html, F.col("url")), "lang": web.language(html), "wordCount": t.count_words(t.strip_html(content)), "extraction": label, "convertedAt": F.lit("2026-01-01T00:00:00.000Z")}
    return _pages(spark, sf_dir).select("page_id", built(fields).alias("front_matter"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '(?s)\\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\\.(?:jpe?g|png|gif|webp|svg|bmp)\\z')
 THEN lower(regexp_extract(regexp_extract(url, '(?s)\\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\\.[A-Za-z]+)\\z', 1)) ELSE '.jpg' END AS ext, 'url' AS input_type FROM pages""")
def page_url_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", web.image_extension("url").alias("ext"), web.input_type("url").alias("input_type"))


@query(f"""WITH h AS (SELECT page_id, {Sql.host('url')} AS host, length(html) AS n FROM pages)
SELECT host, count(*) AS pages, max(n) AS longest, min(page_id) AS first_page FROM h GROUP BY host""")
def page_hosts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("page_id", web.host("url").alias("host"), F.length("html").cast("long").alias("n"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.max("n").alias("longest"), F.min("page_id").alias("first_page"))


@query(f"""WITH h AS (SELECT page_id, {Sql.host('url')} AS host, length(html) AS n FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) AS k FROM h)
SELECT host, page_id, CAST(k AS INT) AS rank FROM r WHERE k <= 3""")
def page_top_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest pages of each host (a report)."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), "page_id"))
    rows = _pages(spark, sf_dir).select("page_id", web.host("url").alias("host"), F.length("html").alias("n"))
    return rows.withColumn("rank", rank).where("rank <= 3").select("host", "page_id", "rank")


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-tier extraction on the tree: by site, by score, by fallback; noise removed; Markdown."""
    return extraction.extract_pages(_pages(spark, sf_dir)).select("page_id", "title", "extraction", "markdown", "removed", "error")


@query()
def page_content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of every page in reading order."""
    kind = "array<struct<type:string,text:string,text_level:int,sub_type:string,list_items:array<string>,img_path:string,table_rows:array<array<string>>>>"
    rows = extraction.extract_pages(_pages(spark, sf_dir)).select("page_id", F.posexplode(F.from_json("blocks", kind)).alias("pos", "b"))
    return rows.select("page_id", "pos", "b.type", "b.text", "b.text_level", "b.sub_type", "b.list_items", "b.img_path", "b.table_rows")


@query()
def page_front_matter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter written and read again: its fields as JSON, and the body after it."""
    return page_front_matter(spark, sf_dir).select("page_id", parse_column(F.concat("front_matter", F.lit("\nbody"))).alias("p")).select("page_id", "p.fields", "p.body", "p.found")
