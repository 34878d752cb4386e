"""Queries on blocks, names, dates, addresses and index lines, made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vellumix.functions import text as t, web
from vellumix.operators import library, ordered, planning
from vellumix.plans.registry import Sql, query, table

_ITEMS = """i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS pos, CASE l_returnflag WHEN 'N' THEN 'image' ELSE 'paragraph' END AS kind,
 CASE l_returnflag WHEN 'R' THEN l_partkey % 9 END AS num FROM lineitem)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks: images, figure labels and other paragraphs."""
    flag = F.col("l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("pos"), F.when(flag == "N", "image").otherwise("paragraph").alias("kind"),
        F.when(flag == "R", F.concat(F.lit(" 图 "), (F.col("l_partkey") % 9).cast("string"))).when(flag == "A", "other words").alias("text"),
    )


@query(f"""WITH {_ITEMS}, s AS (SELECT *, max(CASE WHEN kind <> 'image' AND num IS NULL THEN pos ELSE -1 END) OVER (PARTITION BY doc) AS stop FROM i)
SELECT doc, pos, pos > stop AND count(*) FILTER (kind = 'image' AND pos > stop) OVER (PARTITION BY doc) > 0 AS trailing FROM s""")
def trailing_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.trailing_figures(_items(spark, sf_dir), "doc", "pos", "kind", "text").select("doc", F.col("pos").cast("long").alias("pos"), "trailing")


@query(f"""WITH RECURSIVE {_ITEMS}, m AS (SELECT doc, pos, kind = 'image' AS image, num, row_number() OVER (PARTITION BY doc ORDER BY pos) AS nth FROM i WHERE kind = 'image' OR num IS NOT NULL),
w(doc, nth, pending, open, shown, named) AS (SELECT doc, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT doc FROM m)
 UNION ALL SELECT w.doc, m.nth, CASE WHEN m.image THEN NULL WHEN w.open THEN w.pending ELSE m.num END, CASE WHEN m.image THEN w.pending IS NULL ELSE false END,
  CASE WHEN m.image THEN m.pos ELSE w.shown END, CASE WHEN m.image THEN w.pending WHEN w.open THEN m.num ELSE w.named END FROM w JOIN m ON m.doc = w.doc AND m.nth = w.nth + 1),
own AS (SELECT doc, shown AS pos, arg_max(coalesce(named, -1), nth) AS num, row_number() OVER (PARTITION BY doc ORDER BY shown) AS k FROM w WHERE shown IS NOT NULL GROUP BY doc, shown),
n AS (SELECT *, max(CASE WHEN num >= 0 THEN k END) OVER (PARTITION BY doc ORDER BY k) AS since FROM own)
SELECT n.doc, n.pos, CAST(n.k + coalesce(b.num - b.k, 0) AS BIGINT) AS num FROM n LEFT JOIN own b ON b.doc = n.doc AND b.k = n.since""")
def figure_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.number_figures(_items(spark, sf_dir), "doc", "pos", "kind", "text")


@query("""WITH u AS (SELECT 'b' || (l_suppkey % 20) AS book, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS pos, 'p' || l_partkey || CASE l_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif' ELSE '' END AS name FROM lineitem),
f AS (SELECT book, name, min(pos) AS used FROM u WHERE CAST(regexp_extract(name, 'p([0-9]+)', 1) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY book, name)
SELECT book, name, book || '_' || row_number() OVER (PARTITION BY book ORDER BY used, name) || CASE WHEN name LIKE '%.PNG' THEN '.png' WHEN name LIKE '%.gif' THEN '.gif' ELSE '.jpg' END AS file FROM f""")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def name(key: str) -> Column:
        ext = F.when(F.col(key) % 3 == 0, ".PNG").when(F.col(key) % 3 == 1, ".gif").otherwise("")
        return F.concat(F.lit("p"), F.col(key).cast("string"), ext)

    pos = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")
    uses = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), (F.col("l_suppkey") % 20).cast("string")).alias("book"), pos.alias("pos"), name("l_partkey").alias("name"))
    return ordered.book_files(uses, table(spark, sf_dir, "part").where("p_size > 10").select(name("p_partkey").alias("name")), "book", "pos", "name")


@query("SELECT o_orderkey, CASE WHEN o_orderdate IS NULL OR o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 1 THEN 'T21:04:05.250Z' WHEN o_orderkey % 5 = 2 THEN 'T10:20:30.000Z' ELSE 'T00:00:00.000Z' END END AS iso FROM orders")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in the forms that pages carry: a day, a time with zone, a mail date, an English date, and no date."""
    k, at = F.col("o_orderkey") % 5, lambda form: F.date_format("o_orderdate", form)
    text = (
        F.when(k == 0, at("yyyy-MM-dd")).when(k == 1, F.concat(at("yyyy-MM-dd'T'"), F.lit("23:34:05.25+02:30"))).when(k == 2, F.concat(at("EEE, d MMM yyyy"), F.lit(" 10:20:30 GMT")))
        .when(k == 3, at("MMMM d, yyyy")).otherwise("not a date 2020")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", t.iso_time(text).alias("iso"))


@query(f"SELECT doc_id, md5({Sql.re('lower(text)', (r'[^\p{L}\p{N}]+', ''))}) AS heading_key FROM documents")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(text.isNotNull(), F.md5(t.heading_key(text))).alias("heading_key"))


@query(f"SELECT p_partkey, {Sql.squeeze('p_name')} || ' & x ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END AS heading FROM part")
def plain_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a link, code, emphasis, a tag, entities and an escape around them."""
    even = F.col("p_partkey") % 2 == 0
    name = F.when(even, F.concat(F.lit("**["), "p_name", F.lit("](u)** &amp; <b>x</b> "))).otherwise(F.concat(F.lit("`"), "p_name", F.lit("` &#38; &#x78;  ")))
    return table(spark, sf_dir, "part").select("p_partkey", t.plain_heading(F.concat(name, F.lit("_"), F.col("p_size").cast("string"), F.lit("_"), F.when(even, r"\*").otherwise(""))).alias("heading"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_name END AS title FROM part")
def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("发明名称："), name)).when(k == 1, F.concat(F.lit(" 实用新型名称 : "), name, F.lit("  "))).when(k == 2, F.concat(F.lit("发明创造名称"), name)).otherwise(F.concat(F.lit("名称："), name))
    return table(spark, sf_dir, "part").select("p_partkey", t.title_field(text).alias("title"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id * 7919 % 256 IN (0, 10, 127) OR event_id * 7919 % 256 >= 224 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN event_id * 7919 % 256 IN (0, 10, 127) OR event_id * 7919 % 256 >= 224
WHEN 4 THEN event_id * 7919 % 256 IN (0, 10, 127) OR event_id * 7919 % 256 >= 224 ELSE true END AS private FROM events""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that embed an IPv4 address (mapped, 6to4, NAT64), public and local ones, and what is no address."""
    i = F.col("event_id")
    first = i * 7919 % 256
    byte, tail = F.lpad(F.lower(F.hex(first)), 2, "0"), F.lower(F.hex(i % 65536))
    v4 = F.concat(first.cast("string"), F.lit(".9.3.4"))
    text = (
        F.when(i % 6 == 0, F.concat(F.lit("[::FFFF:"), v4, F.lit("]"))).when(i % 6 == 1, F.concat(F.lit("2001:db8::"), tail)).when(i % 6 == 2, F.concat(F.lit("fe80::"), tail, F.lit("%eth0")))
        .when(i % 6 == 3, F.concat(F.lit("2002:"), byte, F.lit("09:304::1"))).when(i % 6 == 4, F.concat(F.lit("64:ff9b::"), v4)).otherwise(F.concat(F.lit("1::2::"), tail))
    )
    return table(spark, sf_dir, "events").select("event_id", web.private_address(text).alias("private"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/o/' || p_partkey || ',/x/' || p_size || ',/o/' || p_partkey || '/a/b.png' WHEN 1 THEN '/o/' || p_partkey || ',/o/' || p_partkey || '/c' ELSE '/o/' || p_partkey END AS paths FROM part""")
def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, path = F.col("p_partkey") % 3, F.concat(F.lit("/o/"), F.col("p_partkey").cast("string"))
    outputs = F.when(k == 0, F.array(F.concat(F.lit("/x/"), F.col("p_size").cast("string")), path)).when(k == 1, F.array(F.lit("")))
    extras = F.when(k == 0, F.array(F.lit("a/b.png"), F.lit("../../e"), F.lit("/abs"))).when(k == 1, F.array(F.lit("./c"), F.lit("c")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(library.record_paths(path, outputs, extras), ",").alias("paths"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'r' || (doc_id // 2) END AS id, CASE doc_id % 7 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'version' WHEN 2 THEN 'no output path' ELSE CASE WHEN row_number() OVER (PARTITION BY doc_id % 7 < 3, doc_id // 2 ORDER BY doc_id) > 1 THEN 'repeated id' END END AS issue FROM documents""")
def lib_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines, some broken, of another version, without a path or with an id that came before."""
    i = F.col("doc_id")
    own = F.to_json(F.struct(F.when(i % 7 == 1, 2).otherwise(1).alias("version"), F.concat(F.lit("r"), F.floor(i / 2).cast("string")).alias("id"), F.when(i % 7 == 2, " ").otherwise("/o").alias("output_path"), F.col("source").alias("title")))
    lines = table(spark, sf_dir, "documents").select(i.alias("ord"), F.when(i % 7 == 0, F.concat(F.lit("{"), F.col("source"))).otherwise(own).alias("value"))
    return library.loaded(lines, "id STRING, output_path STRING, title STRING").select(F.col("ord").alias("doc_id"), "id", "issue")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'repeated' WHEN 2 THEN 'unknown' END AS problem, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 3 THEN p_brand || ',' || p_brand ELSE p_brand END AS warnings FROM part""")
def parts_and_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a request's parts list, and the warnings of three stages one after the other."""
    k, none = F.col("p_partkey") % 5, F.lit(None).cast("array<string>")
    parts = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("claims"), F.lit("claims"))).when(k == 2, F.array(F.lit("claims"), F.lit("cover"))).otherwise(F.array(F.lit("claims"), F.lit("abstract")))
    own = F.when(k != 0, F.array("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", planning.parts_problem(parts).alias("problem"), F.array_join(planning.warnings_in_order(own, none, F.when(k == 3, own)), ",").alias("warnings"))


@query("""WITH d AS (SELECT l_partkey AS k, min({'ord': l_orderkey * 10 + l_linenumber, 'display': CAST(l_quantity AS BIGINT) || 'x' || l_linenumber}).display AS display FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey) SELECT p_partkey, display FROM part LEFT JOIN d ON k = p_partkey""")
def sized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("i/"), F.col("l_partkey").cast("string")).alias("source_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_quantity") > 25, F.concat_ws("x", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"))).alias("display"))
    images = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("i/"), F.col("p_partkey").cast("string")).alias("source_path"))
    return planning.sized_images(images, layout).select("p_partkey", "display")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS used FROM conversations WHERE role <> '' GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY used, role) AS names FROM f GROUP BY conv_id""")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distinct_names(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("names", ",").alias("names"))
