"""Queries on a library of results: its records are made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellumix.operators import library
from vellumix.plans.registry import query, table

NOW = "2026-06-01T00:00:00.000Z"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library records of all documents and their labels; identifiers, times and paths follow from doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("length(text)").alias("n"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    stamp = F.concat(F.lit("2026-0"), (i % 5 + 1).cast("string"), F.lit("-1"), (i % 10).cast("string"), F.lit("T00:00:00.000Z"))
    url = i % 3 == 0
    return rows.select(
        i.alias("ord"), F.concat(F.lit("r"), i.cast("string")).alias("id"), stamp.alias("created_at"), stamp.alias("updated_at"),
        F.when(url, "url").otherwise("file").alias("source_kind"), F.when(url, F.concat(F.lit("https://"), "source", F.lit(".example.org/p/"), i.cast("string"))).otherwise(F.concat(F.lit("/in/"), "source", F.lit("/d"), i.cast("string"), F.lit(".docx"))).alias("source_value"),
        F.when(url, "url").when(i % 3 == 1, "docx").otherwise("md").alias("source_type"), F.when(url, F.concat("source", F.lit(".example.org"))).otherwise("").alias("source_host"),
        F.when(url, "").otherwise(F.concat(F.lit("/in/"), "source")).alias("source_dir"), F.when(i % 3 == 2, "docx").otherwise("bundle").alias("target"),
        F.concat(F.lit("d"), i.cast("string")).alias("name"), F.concat(F.col("lang"), F.lit(" Report "), (F.col("n") % 100).cast("string")).alias("title"),
        F.concat(F.when(i % 7 == 0, F.lit("/root/lib/old/")).otherwise(F.lit("/out/")), "source", F.lit("/d"), (i % 400).cast("string"), F.when(i % 2 == 0, F.lit(".docx")).otherwise(F.lit(""))).alias("output_path"),
        library.tags(F.array(F.concat(F.lit(" "), "lang", F.lit(" ")), F.when(F.col("quality") == 1, "good").otherwise(""), F.when(F.col("toxic") == 1, "toxic").otherwise(""), F.col("lang"))).alias("tags"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("favorite"), (i % 11 == 0).alias("managed"),
    )


_R = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT d.doc_id AS ord, 'r' || d.doc_id AS id, '2026-0' || (d.doc_id % 5 + 1) || '-1' || (d.doc_id % 10) || 'T00:00:00.000Z' AS created_at, '2026-0' || (d.doc_id % 5 + 1) || '-1' || (d.doc_id % 10) || 'T00:00:00.000Z' AS updated_at,
 CASE WHEN d.doc_id % 3 = 0 THEN 'url' ELSE 'file' END AS source_kind, CASE WHEN d.doc_id % 3 = 0 THEN 'https://' || source || '.example.org/p/' || d.doc_id ELSE '/in/' || source || '/d' || d.doc_id || '.docx' END AS source_value,
 CASE d.doc_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'docx' ELSE 'md' END AS source_type, CASE WHEN d.doc_id % 3 = 0 THEN source || '.example.org' ELSE '' END AS source_host, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE '/in/' || source END AS source_dir,
 CASE WHEN d.doc_id % 3 = 2 THEN 'docx' ELSE 'bundle' END AS target, 'd' || d.doc_id AS name, lang || ' Report ' || (length(text) % 100) AS title,
 CASE WHEN d.doc_id % 7 = 0 THEN '/root/lib/old/' ELSE '/out/' END || source || '/d' || (d.doc_id % 400) || CASE WHEN d.doc_id % 2 = 0 THEN '.docx' ELSE '' END AS output_path,
 [x FOR x IN [lang, CASE WHEN quality = 1 THEN 'good' ELSE '' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END] IF x <> ''] AS tags, coalesce(quality = 1, false) AS favorite, d.doc_id % 11 = 0 AS managed FROM documents d LEFT JOIN lab USING (doc_id))"""
_DIR = "CASE WHEN source_kind = 'url' THEN source_host ELSE source_dir END"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


_COLS = "* REPLACE (array_to_string(tags, ',') AS tags)"


@query(f"WITH {_R} SELECT {_COLS} FROM r")
def lib_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records(spark, sf_dir))


_SEARCH = "(contains(lower(title), 'de r') OR contains(lower(name), 'de r') OR contains(lower(source_value), 'de r') OR len([x FOR x IN tags IF contains(lower(x), 'de r')]) > 0)"


@query(f"WITH {_R} SELECT id, title FROM r WHERE {_SEARCH}")
def lib_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(records(spark, sf_dir), " De R").select("id", "title")


@query(f"WITH {_R} SELECT id, created_at, target FROM r WHERE source_type = 'docx' AND target = 'bundle' AND left(created_at, 7) = '2026-03' AND list_contains(tags, 'en') AND NOT favorite")
def lib_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = {"source_type": "docx", "target": "bundle", "month": "2026-03", "tag": "en", "favorite": False}
    return library.search(records(spark, sf_dir), "", facets).select("id", "created_at", "target")


@query(f"""WITH {_R}, f AS (SELECT * FROM r WHERE {_SEARCH}), p AS (SELECT 'source_type' AS facet, source_type AS value FROM f UNION ALL SELECT 'target', target FROM f UNION ALL SELECT 'month', left(created_at, 7) FROM f
UNION ALL SELECT 'source_dir', {_DIR} FROM f UNION ALL SELECT 'tag', unnest(tags) FROM f UNION ALL SELECT 'favorite', CAST(favorite AS VARCHAR) FROM f)
SELECT facet, value, count(*) AS count FROM p WHERE value <> '' GROUP BY facet, value""")
def lib_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.facet_counts(library.search(records(spark, sf_dir), "de r"))


@query(f"WITH {_R}, p AS (SELECT unnest(tags) AS value FROM r) SELECT value, count(*) AS count FROM p GROUP BY value")
def lib_tag_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.facet_counts(records(spark, sf_dir)).where("facet = 'tag'").select("value", "count")


@query(f"WITH {_R} SELECT count(*) AS total FROM r WHERE {_SEARCH}")
def lib_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(records(spark, sf_dir), "de r").agg(F.count("*").alias("total"))


@query(f"WITH {_R} SELECT id, created_at, title FROM r ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def lib_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty, newest first (paging is the feature)."""
    return library.page(records(spark, sf_dir), "created_at", True, 40, 20).select("id", "created_at", "title")


@query(f"""WITH {_R}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY ord) = 1), n AS (SELECT output_path || CASE WHEN ord % 4 = 0 THEN '-new' ELSE '' END AS output_path, 'new ' || title AS title, 'n' || id AS id FROM u WHERE ord % 2 = 0)
SELECT coalesce(u.id, n.id) AS id, coalesce(u.output_path, n.output_path) AS output_path, coalesce(n.title, u.title) AS title, coalesce(u.created_at, '{NOW}') AS created_at, CASE WHEN n.id IS NOT NULL THEN '{NOW}' ELSE u.updated_at END AS updated_at FROM u FULL JOIN n ON u.output_path = n.output_path""")
def lib_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = records(spark, sf_dir)
    own = all_.groupBy("output_path").agg(F.min_by(F.struct(*all_.columns), "ord").alias("r")).select("r.*")
    new = own.where("ord % 2 = 0").withColumns({"output_path": F.concat("output_path", F.when(F.col("ord") % 4 == 0, "-new").otherwise("")), "title": F.concat(F.lit("new "), "title"), "id": F.concat(F.lit("n"), "id")})
    return library.upsert(own, new, NOW).select("id", "output_path", "title", "created_at", "updated_at")


@query(f"""WITH {_R} SELECT id, CASE WHEN ord % 6 = 0 THEN name WHEN ord % 3 = 0 THEN 'T' || ord ELSE title END AS title, CASE WHEN ord % 3 = 0 THEN true ELSE favorite END AS favorite, CASE WHEN ord % 3 = 0 THEN '{NOW}' ELSE updated_at END AS updated_at FROM r""")
def lib_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    changes = own.where("ord % 3 = 0").select("id", F.when(F.col("ord") % 6 == 0, "  ").otherwise(F.concat(F.lit(" T"), F.col("ord").cast("string"))).alias("title"), F.lit(True).alias("favorite"))
    return library.patch(own, changes, NOW).select("id", "title", "favorite", "updated_at")


@query(f"WITH {_R} SELECT id FROM r WHERE ord % 5 <> 0")
def lib_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    return library.remove(own, own.where("ord % 5 = 0")).select("id")


@query(f"WITH {_R} SELECT id, CASE WHEN starts_with(output_path, '/out/src1/') THEN '/lib/a' || substr(output_path, 10) ELSE output_path END AS output_path, managed OR starts_with(output_path, '/out/src1/') AS managed FROM r")
def lib_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.relocate(records(spark, sf_dir), "/out/src1", "/lib/a", NOW).select("id", "output_path", "managed")


@query(f"""WITH {_R}, k AS (SELECT *, CASE WHEN managed THEN 'already managed' WHEN starts_with(output_path, '/root/lib/') THEN 'already inside the root' END AS reason, string_split(output_path, '/')[-1] AS base FROM r),
m AS (SELECT *, '/root/lib/' || left(created_at, 7) || '/' || base AS want FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY want, reason IS NULL ORDER BY ord) AS c FROM m)
SELECT id, output_path AS from_path, CASE WHEN reason IS NULL THEN CASE WHEN c = 1 THEN want WHEN ord % 2 = 0 THEN left(want, length(want) - 5) || ' (' || c || ').docx' ELSE want || ' (' || c || ')' END END AS to_path, reason IS NULL AND c > 1 AS conflict, reason FROM n""")
def lib_migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.migration_plan(records(spark, sf_dir), "/root/lib")


@query(f"WITH {_R} SELECT id FROM r WHERE output_path NOT IN (SELECT output_path FROM r WHERE ord % 2 = 0)")
def lib_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = records(spark, sf_dir)
    return library.absent(own, own.where("ord % 2 = 0")).select("id")
