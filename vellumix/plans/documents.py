"""Queries on documents and conversations: text functions, lines, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellumix.functions import text as t
from vellumix.operators import ordered
from vellumix.plans.registry import Sql, query, table
from vellumix.sources import markdown, office, word_writer


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


@query(f"SELECT doc_id, md5({Sql.normalize('text')}) AS body, length({Sql.normalize('text')}) AS n FROM documents")
def doc_normalize_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = t.normalize_markdown(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", body.alias("b")).select("doc_id", F.md5("b").alias("body"), F.length("b").cast("long").alias("n"))


@query(f"SELECT doc_id, md5({Sql.strip_html('text')}) AS body FROM documents")
def doc_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.strip_html(F.col("text"))).alias("body"))


@query(f"SELECT doc_id, {Sql.words('text')} AS words FROM documents")
def doc_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.count_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, {Sql.truncate(Sql.squeeze('text'))} AS excerpt FROM documents")
def doc_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.truncate(t.squeeze(F.col("text"))).alias("excerpt"))


@query("SELECT doc_id, left(text, 50000) AS body, length(text) > 50000 AS truncated FROM documents")
def doc_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, cut = t.clipped(F.col("text"), 50_000)
    return _docs(spark, sf_dir).select("doc_id", body.alias("body"), cut.alias("truncated"))


@query(f"SELECT doc_id, {Sql.folder('text')} AS name FROM documents")
def doc_folder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.folder_name(F.col("text")).alias("name"))


@query(f"""SELECT doc_id, md5({Sql.re("text", ("\r\n", "\n"), (r"(?m)^(#{1,6})([^#" + t.WS + "])", r"\1 \2"))}) AS body FROM documents""")
def doc_heading_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.preprocess_headings(F.col("text"))).alias("body"))


@query("""SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS body FROM documents""")
def doc_xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.xml_text(F.col("text"))).alias("body"))


@query(f"""SELECT doc_id, md5({Sql.re(Sql.squeeze("text"), (r"\|", r"\\|"))}) AS cell FROM documents""")
def doc_table_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.cell_text(F.col("text"))).alias("cell"))


@query("SELECT doc_id, md5(replace(text, chr(10), ' ')) AS soft, md5(replace(text, chr(10), ' ')) AS hard FROM documents")
def doc_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.join_soft_breaks(F.col("text"))).alias("soft"), F.md5(t.join_line_breaks(F.col("text"))).alias("hard"))


@query(f"SELECT doc_id, CAST({Sql.n('lower(text)', 'the')} AS BIGINT) AS hits FROM documents")
def doc_find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.find_count(F.col("text"), "The").alias("hits"))


@query(f"""SELECT doc_id, CASE WHEN lower({Sql.trim('source')}) IN ('un-named', 'unknown', 'src3') THEN '' ELSE {Sql.trim('source')} END AS author FROM documents""")
def doc_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.normalize_author(F.col("source"), (*t.PLACEHOLDER_AUTHORS, "src3")).alias("author"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1***', 'g'), '(?i)((?:token|key|secret|password)=)[^&\s"'']+', '\1***', 'g')) AS body FROM documents""")
def doc_scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.scrub_secrets(F.col("text"))).alias("body"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


_LINES = "l AS (SELECT doc_id, CAST(i AS INT) AS line_no, a[i + 1] AS line FROM (SELECT doc_id, a, unnest(range(0, len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"


@query(f"""WITH {_LINES} SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '\\A {{0,3}}#{{1,6}}([ \\t]|\\z)') THEN 1 ELSE 0 END) AS BIGINT) AS headings,
CAST(sum(CASE WHEN regexp_matches(line, '\\A {{0,3}}(?:[-*+]|[0-9]{{1,9}}[.)])(?:[ \\t]|\\z)') THEN 1 ELSE 0 END) AS BIGINT) AS items,
CAST(sum(CASE WHEN regexp_matches(line, '[|]') THEN 1 ELSE 0 END) AS BIGINT) AS rows, count(*) AS lines FROM l GROUP BY doc_id""")
def doc_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.split("text", "\n", -1)
    count = lambda p: F.size(F.filter(own, lambda s: s.rlike(p))).cast("long")
    return _docs(spark, sf_dir).select("doc_id", count(r"\A {0,3}#{1,6}([ \t]|\z)").alias("headings"), count(r"\A {0,3}(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|\z)").alias("items"), count(r"[|]").alias("rows"), F.size(own).cast("long").alias("lines"))


@query(f"""WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\\A {{0,3}}```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l),
h AS (SELECT doc_id, line_no, line FROM s WHERE n % 2 = 0 AND regexp_matches(line, '\\A {{0,3}}#{{1,6}}[ \\t]'))
SELECT doc_id, line_no, CAST(length(regexp_extract(line, '\\A {{0,3}}(#{{1,6}})', 1)) AS INT) AS level, {Sql.squeeze(r"regexp_replace(line, '\A {0,3}#{1,6}[ \t]', '')")} AS title FROM h""")
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered.fenced(lines(spark, sf_dir), "doc_id", "line_no", "line").where(~F.col("inside") & F.col("line").rlike(r"\A {0,3}#{1,6}[ \t]"))
    return found.select("doc_id", "line_no", F.length(F.regexp_extract("line", r"\A {0,3}(#{1,6})", 1)).alias("level"), t.squeeze(F.regexp_replace("line", r"\A {0,3}#{1,6}[ \t]", "")).alias("title"))


#: A line opens a claim in this reading if it starts with a word of at most three letters.
_OPENS = r"\A[A-Za-z]{1,3} "


@query(f"""WITH {_LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '\\A[A-Za-z]{{1,3}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM l)
SELECT doc_id, CAST(grp AS BIGINT) AS claim_ord, count(*) AS parts, min(line_no) AS first_line FROM s GROUP BY doc_id, grp""")
def doc_claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = lines(spark, sf_dir).withColumn("line2", F.when(F.col("line").rlike(_OPENS), F.lit("1. x")).otherwise(F.lit("x")))
    grouped = ordered.group_claims(numbered, "doc_id", "line_no", "line2")
    return grouped.groupBy("doc_id", "claim_ord").agg(F.count("*").alias("parts"), F.min("line_no").alias("first_line"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, left(line, 1) AS g FROM l), s AS (SELECT *, CASE WHEN g = lag(g) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS st FROM k)
SELECT doc_id, line_no, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS island FROM s""")
def doc_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.substring("line", 1, 1).alias("g"))
    return ordered.islands(rows, "doc_id", "line_no", "g").select("doc_id", "line_no", "island")


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, CASE WHEN length(line) < 40 THEN line END AS header FROM l)
SELECT doc_id, line_no, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM k""")
def doc_section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.when(F.length("line") < 40, F.col("line")).alias("header"))
    return ordered.carry_forward(rows, "doc_id", "line_no", "header", "section").select("doc_id", "line_no", "section")


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, upper(left(line, 1)) AS p FROM l WHERE line <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY line_no) AS r FROM k)
SELECT doc_id, line_no, p || CASE WHEN r < 10000 THEN lpad(CAST(r AS VARCHAR), 4, '0') ELSE CAST(r AS VARCHAR) END AS block_id FROM n""")
def doc_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("line <> ''").select("doc_id", "line_no", t.capital(F.substring("line", 1, 1)).alias("p"))
    return ordered.ids_per_prefix(rows, "doc_id", "p", "line_no").select("doc_id", "line_no", "block_id")


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, length(line) AS n FROM l), b AS (SELECT *, max(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k)
SELECT doc_id, line_no, CAST(n AS INT) AS n FROM b WHERE m IS NULL OR n > m""")
def doc_monotone_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("n"))
    return ordered.increasing_only(rows, "doc_id", "line_no", "n")


@query(f"""WITH {_LINES}, f AS (SELECT doc_id, line_no, line, min(line_no) OVER (PARTITION BY doc_id, line) AS f FROM l)
SELECT doc_id, line_no, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS BIGINT) AS image_no FROM f""")
def doc_first_use_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.numbered_by_first_use(lines(spark, sf_dir), "doc_id", "line_no", "line").select("doc_id", "line_no", "image_no")


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, regexp_extract_all(line, '[^A-Za-z0-9[:space:].,|]') AS c, line_no + 1 AS p FROM l),
d AS (SELECT doc_id, p, list_sort(list_distinct(c)) AS k FROM m WHERE len(c) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM d)
SELECT doc_id, CAST(p AS BIGINT) AS paragraph, array_to_string(k[1:3], ' ') || CASE WHEN len(k) > 3 THEN ' +' || CAST(len(k) - 3 AS VARCHAR) ELSE '' END AS found FROM r WHERE n <= 10
UNION ALL SELECT doc_id, CAST(NULL AS BIGINT), 'more: ' || CAST(count(*) AS VARCHAR) FROM r WHERE n > 10 GROUP BY doc_id""")
def doc_charset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the first ten paragraphs with odd characters, three kinds of them each, and one row for the rest."""
    chars = F.array_sort(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[^A-Za-z0-9\t\n\x0B\f\r\x20.,|]"), F.lit(0))))
    odd = lines(spark, sf_dir).select("doc_id", (F.col("line_no") + 1).cast("long").alias("p"), chars.alias("k")).where(F.size("k") > 0)
    per = odd.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("all"))
    shown = F.transform(F.slice("all", 1, 10), lambda r: F.struct(r["p"].alias("paragraph"), F.concat(F.array_join(F.slice(r["k"], 1, 3), " "), F.when(F.size(r["k"]) > 3, F.concat(F.lit(" +"), (F.size(r["k"]) - 3).cast("string"))).otherwise("")).alias("found")))
    rest = F.when(F.size("all") > 10, F.array(F.struct(F.lit(None).cast("long").alias("paragraph"), F.concat(F.lit("more: "), (F.size("all") - 10).cast("string")).alias("found")))).otherwise(F.array().cast("array<struct<paragraph:bigint,found:string>>"))
    return per.select("doc_id", F.explode(F.concat(shown, rest)).alias("r")).select("doc_id", "r.paragraph", "r.found")


_ROLES = "CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'answer' ELSE 'note' END"


@query(f"SELECT conv_id, turn AS pos, {_ROLES} AS kind, {Sql.squeeze('text')} AS text, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS BIGINT) AS ordinal FROM conversations")
def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "answer").otherwise("note")
    ordinal = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), kind.alias("kind"), t.squeeze(F.col("text")).alias("text"), ordinal.alias("ordinal"))


@query(f"SELECT conv_id, md5(string_agg('## ' || role || chr(10) || chr(10) || {Sql.normalize('text')}, chr(10) || chr(10) ORDER BY turn)) AS body, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), t.normalize_markdown(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    body = F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(body).alias("body"), F.count("*").alias("turns"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, line_no, line, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l)
SELECT doc_id, count(DISTINCT g) AS paragraphs FROM p WHERE trim(line) <> '' GROUP BY doc_id""")
def doc_paragraph_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that blank lines part."""
    parts = F.filter(F.split("text", r"\n[ ]*(?=\n|\z)", -1), lambda p: p.rlike(rf"[^{t.WS}]"))
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("paragraphs")).where("paragraphs > 0")


@query()
def doc_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as Markdown: typed blocks as JSON."""
    return markdown.read_markdown(_docs(spark, sf_dir))


@query()
def doc_word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as word-processor files and read again: how many blocks come back, and of what kinds."""
    files = word_writer.to_word(doc_markdown_blocks(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("path"), "content")
    back = office.read_word(files)
    return back.groupBy("path").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("error").isNotNull()).alias("errors"))
