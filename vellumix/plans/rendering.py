"""Queries that render: pages as XML, HTML and JSON, conversations as patent books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellumix.operators import patent, rendering
from vellumix.plans.pages import page_content_blocks
from vellumix.plans.registry import fixture, query, table
from vellumix.sources import xml


@query()
def page_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.to_xml(page_content_blocks(spark, sf_dir), "page_id")


@query()
def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.to_html(page_content_blocks(spark, sf_dir), "page_id", theme="paper", spacing="compact")


@query()
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.to_json(page_content_blocks(spark, sf_dir), "page_id")


@query()
def page_xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered XML scanned back into node rows."""
    return xml.scan(page_xml(spark, sf_dir), "page_id", "xml")


_PATENT = """('a', 1, 'heading', '权利要求书'), ('a', 2, 'paragraph', '1. 一种装置'), ('a', 3, 'paragraph', '其中 <x>'), ('a', 4, 'paragraph', '3、如上'), ('a', 5, 'paragraph', '说 明 书'), ('a', 6, 'paragraph', '技术领域'),
('a', 7, 'paragraph', '[0001] 第一段，这是一个足够长的段落。'), ('a', 8, 'paragraph', '［0005］第二段，这是一个足够长的段落。'), ('a', 9, 'heading', '说明书附图'), ('a', 10, 'image', 'f1.jpg'), ('a', 11, 'paragraph', '图2'), ('a', 12, 'heading', '摘要：'), ('a', 13, 'paragraph', '本发明公开了一种装置及其方法。'),
('b', 1, 'heading', '说明书'), ('b', 2, 'paragraph', '只有说明书的文件，没有别的内容。')"""
_blocks, _BLOCKS = fixture("doc, pos, kind, text", _PATENT)


@query("""SELECT * FROM (VALUES ('a', 'claims', '<claims>' || chr(10) || '<claim id="cl001" num="001"><claim-text>一种装置</claim-text><claim-text>其中 &lt;x&gt;</claim-text></claim>' || chr(10) || '<claim id="cl003" num="003"><claim-text>如上</claim-text></claim>' || chr(10) || '</claims>'),
('a', 'description', '<description>' || chr(10) || '<heading level="2">技术领域</heading>' || chr(10) || '<p id="p0001" num="0001">第一段，这是一个足够长的段落。</p>' || chr(10) || '<p id="p0005" num="0005">第二段，这是一个足够长的段落。</p>' || chr(10) || '</description>'),
('a', 'drawings', '<drawings>' || chr(10) || '<figure id="f0001" num="0002"><img file="f1.jpg"/></figure>' || chr(10) || '</drawings>'), ('a', 'abstract', '<abstract>' || chr(10) || '<p>本发明公开了一种装置及其方法。</p>' || chr(10) || '</abstract>'),
('b', 'description', '<description>' || chr(10) || '<p id="p0001" num="0001">只有说明书的文件，没有别的内容。</p>' || chr(10) || '</description>')) AS t(doc, book, xml)""")
def patent_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patent.render(_blocks(spark))


@query("SELECT * FROM (VALUES ('b', 'claims'), ('b', 'drawings'), ('b', 'abstract')) AS t(doc, book)")
def patent_missing_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patent.missing_books(_blocks(spark))


@query("SELECT * FROM (VALUES ('a', 'claims', 2, 3, 0, 0), ('a', 'description', 0, 3, 0, 0), ('a', 'drawings', 0, 1, 0, 1), ('a', 'abstract', 0, 1, 0, 0), ('b', 'description', 0, 1, 0, 0)) AS t(doc, book, claims, paragraphs, headings, figures)")
def patent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patent.summary(_blocks(spark))


@query("""SELECT * FROM (VALUES ('a', 'claims', 'paragraph', 1, '一种装置'), ('a', 'claims', 'paragraph', 1, '其中 <x>'), ('a', 'claims', 'paragraph', 3, '如上'), ('a', 'description', 'heading', NULL, '技术领域'), ('a', 'description', 'paragraph', 1, '第一段，这是一个足够长的段落。'),
('a', 'description', 'paragraph', 5, '第二段，这是一个足够长的段落。'), ('a', 'drawings', 'image', 2, ''), ('a', 'abstract', 'paragraph', NULL, '本发明公开了一种装置及其方法。'), ('b', 'description', 'paragraph', 1, '只有说明书的文件，没有别的内容。')) AS t(doc, book, kind, num, text)""")
def patent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books rendered and imported again."""
    return patent.imported(patent.render(_blocks(spark))).drop("pos")


@query("""WITH n AS (SELECT doc_id, '<?xml version="1.0"?><!-- c --><' || source || ' a="1">' AS x FROM documents) SELECT doc_id, regexp_extract(x, '<(src[0-9]+) ', 1) AS root FROM n""")
def xml_root_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('<?xml version="1.0"?><!-- c --><'), "source", F.lit(' a="1">'))
    return table(spark, sf_dir, "documents").select("doc_id", xml.root_name(text).alias("root"))
