"""What a caller uses: formats, options, converting a folder of documents, reading articles.

    blocks = load(spark, "/data/in")                 # every supported file, as typed blocks
    files = convert(spark, "/data/in", "html")       # a row per document: path, name, target, content
    rows = read_articles(spark, pages)               # pages as articles, with limits on text
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vellumix.functions.text import clipped, count_words, folder_name, strip_extension
from vellumix.functions.web import input_type
from vellumix.operators import extraction, planning, rendering
from vellumix.session import ship
from vellumix.sources import markdown, office, word_writer

BLOCK = "array<struct<type:string,text:string,text_level:int,sub_type:string,list_items:array<string>,img_path:string,table_rows:array<array<string>>>>"
_FIELDS = ("type", "text", "text_level", "sub_type", "list_items", "img_path", "table_rows")


@dataclass(frozen=True)
class Options:
    """Checked options; an unknown name or a value outside its range is refused."""

    theme: str = "plain"
    spacing: str = "normal"
    images: str = "local"
    max_chars: int = 50_000
    recursive: bool = True
    most_files: int | None = None

    @classmethod
    def of(cls, **given: object) -> Options:
        known = {f.name: f for f in fields(cls)}
        if unknown := set(given) - set(known):
            raise ValueError(f"unknown options: {sorted(unknown)}")
        made = cls(**given)
        for name, allowed in (("theme", rendering.THEMES), ("spacing", rendering.SPACING), ("images", rendering.IMAGE_SOURCES)):
            if getattr(made, name) not in allowed:
                raise ValueError(f"{name} must be one of {sorted(allowed)}")
        if not isinstance(made.recursive, bool):
            raise ValueError("recursive must be true or false")
        for name in ("max_chars", "most_files"):
            value = getattr(made, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{name} must be a positive number")
        return made


def list_formats() -> dict[str, object]:
    """Input types by class, and the targets that each class takes."""
    by_class: dict[str, list[str]] = {}
    for target, (classes, _, _) in planning.TARGETS.items():
        for c in classes:
            by_class.setdefault(c, []).append(target)
    return {"inputs": dict(planning.INPUT_CLASS), "targets": by_class, "defaults": dict(planning.DEFAULT_TARGET)}


def _spread(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, pos and the fields of blocks from JSON arrays."""
    return rows.select(key, F.posexplode(F.from_json("blocks", BLOCK)).alias("pos", "b")).select(key, "pos", *[F.col(f"b.{f}").alias(f) for f in _FIELDS])


def _shaped(rows: DataFrame, pos, kind, **given) -> DataFrame:
    types = {"text_level": "int", "list_items": "array<string>", "table_rows": "array<array<string>>"}
    values = {"type": kind} | given
    return rows.select("path", pos.cast("int").alias("pos"), *[values.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f) for f in _FIELDS])


def word_blocks(files: DataFrame) -> DataFrame:
    rows = office.read_word(files).where("error is null")
    kind = F.when(F.col("kind") == "list_item", "list").when(F.col("kind") == "paragraph", "text").otherwise(F.col("kind"))
    image = F.col("kind") == "image"
    return _shaped(rows, F.col("pos"), kind, text=F.when(image, "").otherwise(F.col("text")), text_level=F.col("level"), sub_type=F.when(F.col("kind") == "list_item", "ul"), list_items=F.when(F.col("kind") == "list_item", F.array("text")), img_path=F.when(image, F.col("text")), table_rows=F.col("rows"))


def sheet_blocks(files: DataFrame) -> DataFrame:
    rows = office.read_sheets(files).where("error is null")
    table = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"])
    sheets = rows.groupBy("path", "sheet_idx", "sheet").agg(table.alias("rows"))
    heads = _shaped(sheets, F.col("sheet_idx") * 2, F.lit("heading"), text=F.col("sheet"), text_level=F.lit(2))
    return heads.union(_shaped(sheets, F.col("sheet_idx") * 2 + 1, F.lit("table"), text=F.lit(""), table_rows=F.col("rows")))


def slide_blocks(files: DataFrame) -> DataFrame:
    rows = office.read_slides(files).where("error is null")
    note = F.when(F.col("notes") != "", F.array(F.concat(F.lit("Notes: "), "notes"))).otherwise(F.array().cast("array<string>"))
    parts = rows.select("path", "slide_num", F.posexplode(F.concat(F.array(F.coalesce("title", F.lit(""))), "bodies", note)).alias("i", "text")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy("path").orderBy("slide_num", "i")) - 1
    head = F.col("i") == 0
    return _shaped(parts.withColumn("pos", order), F.col("pos"), F.when(head, "heading").otherwise("text"), text=F.col("text"), text_level=F.when(head, 2))


def load(spark: SparkSession, folder: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """path, pos and block fields of every supported file in a folder; broken files give no blocks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(options.recursive).lower()).load(folder).select("path", "content")
    if options.most_files:
        chosen, _ = planning.scan_order(files, options.most_files)
        files = files.join(F.broadcast(chosen), "path", "left_semi")
    own = lambda kind: files.where(input_type(F.col("path")) == kind)  # noqa: E731  (the columns of others are never read)
    texts = own("md").select("path", F.col("content").cast("string").alias("text"))
    pages = files.where(F.lower("path").rlike(r"\.html?\z")).select(F.col("path").alias("page_id"), F.lit("").alias("url"), F.col("content").cast("string").alias("html"))
    found = _spread(markdown.read_markdown(texts, "path"))
    found = found.unionByName(_spread(extraction.extract_pages(pages).withColumnRenamed("page_id", "path")))
    for kind, read in (("docx", word_blocks), ("xlsx", sheet_blocks), ("pptx", slide_blocks)):
        found = found.unionByName(read(own(kind)))
    return found


def to_markdown(blocks: DataFrame, key: str = "path") -> DataFrame:
    """key and markdown."""
    ship(blocks.sparkSession)
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extraction.markdown_of([{k: v for k, v in b.items() if v is not None} for b in json.loads(x)], "") for x in batch.column("json").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "markdown"])

    return rendering.to_json(blocks, key).mapInArrow(run, f"{key} {kind}, markdown string")


def convert(spark: SparkSession, folder: str, target: str, **given: object) -> DataFrame:
    """path, name, target and content (bytes) of every document in a folder, rendered as md, html, xml, json or docx."""
    options = Options.of(**given)
    blocks = load(spark, folder, options)
    if target == "html":
        made = rendering.to_html(blocks, "path", theme=options.theme, spacing=options.spacing, images=options.images).withColumnRenamed("html", "content")
    elif target == "xml":
        made = rendering.to_xml(blocks, "path").withColumnRenamed("xml", "content")
    elif target == "json":
        made = rendering.to_json(blocks, "path").withColumnRenamed("json", "content")
    elif target == "md":
        made = to_markdown(blocks).withColumnRenamed("markdown", "content")
    elif target == "docx":
        made = word_writer.to_word(rendering.to_json(blocks, "path"), "path", "json")
    else:
        raise ValueError("target must be md, html, xml, json or docx")
    return made.select("path", folder_name(strip_extension(F.col("path"))).alias("name"), F.lit(target).alias("target"), F.col("content").cast("binary").alias("content"))


def read_articles(spark: SparkSession, pages: DataFrame, **given: object) -> DataFrame:
    """Pages (page_id, url, html) as articles; the word count is of the whole text, the text itself is cut."""
    options = Options.of(**given)
    rows = extraction.extract_pages(pages)
    body, cut = clipped(F.col("markdown"), options.max_chars)
    return rows.select("page_id", "title", "extraction", body.alias("markdown"), cut.alias("truncated"), count_words(F.col("markdown")).alias("word_count"), "images", "error")
