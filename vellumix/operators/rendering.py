"""Blocks rendered as XML, HTML and JSON, by expressions: one document per group, in block order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellumix.functions.text import text_of, xml_attribute, xml_text

NAMESPACE = "urn:vellumix:document:1"
#: Room between blocks, and where images may come from.
SPACING = {"compact": ".45em", "normal": ".7em", "loose": "1em"}
IMAGE_SOURCES = {"none": "'none'", "local": "'self' data:", "remote": "'self' data: https: http:"}
THEMES = {
    "plain": ("#222", "#fff", "sans-serif"), "paper": ("#2b2622", "#fbf7ef", "serif"), "night": ("#ddd", "#16181c", "sans-serif"),
    "print": ("#000", "#fff", "serif"), "slate": ("#1f2933", "#f5f7fa", "sans-serif"), "sepia": ("#5b4636", "#f4ecd8", "serif"),
}


def _e(name: str, inner: Column, **attrs: Column) -> Column:
    parts = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        parts += [F.coalesce(F.concat(F.lit(f' {k.rstrip("_")}="'), xml_attribute(v.cast("string")), F.lit('"')), F.lit(""))]
    return F.concat(*parts, F.lit(">"), inner, F.lit(f"</{name}>"))


def _each(items: Column, f) -> Column:
    return F.array_join(F.transform(items, f), "")


def _in_order(blocks: DataFrame, key: str, pos: str, piece: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), piece.alias("piece"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("inner"))


def to_xml(blocks: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """key and xml: one element per block under a document element."""
    text = xml_text(F.col("text"))
    table = _each(F.col("table_rows"), lambda row: F.concat(F.lit("<row>"), _each(row, lambda c: F.concat(F.lit("<cell>"), xml_text(c), F.lit("</cell>"))), F.lit("</row>")))
    items = _each(F.col("list_items"), lambda x: F.concat(F.lit("<item>"), xml_text(x), F.lit("</item>")))
    piece = (
        F.when(F.col("type") == "heading", _e("heading", text, level=F.col("text_level"))).when(F.col("type") == "list", _e("list", items, kind=F.col("sub_type")))
        .when(F.col("type") == "table", _e("table", table)).when(F.col("type") == "code", _e("code", text)).when(F.col("type") == "image", _e("image", text, src=F.col("img_path"))).otherwise(_e("paragraph", text))
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<document xmlns="{NAMESPACE}">'
    return _in_order(blocks, key, pos, piece).select(key, F.concat(F.lit(head), "inner", F.lit("</document>\n")).alias("xml"))


def to_html(blocks: DataFrame, key: str, pos: str = "pos", theme: str = "plain", spacing: str = "normal", images: str = "local") -> DataFrame:
    """key and html: a page with one of the themes and a content policy for its images."""
    text = xml_text(F.col("text"))
    level = F.least(F.greatest(F.coalesce(F.col("text_level"), F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))
    row = lambda r, tag: F.concat(F.lit("<tr>"), _each(r, lambda c: F.concat(F.lit(f"<{tag}>"), xml_text(c), F.lit(f"</{tag}>"))), F.lit("</tr>"))
    rows = F.transform(F.col("table_rows"), lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td")))
    items = _each(F.col("list_items"), lambda x: F.concat(F.lit("<li>"), xml_text(x), F.lit("</li>")))
    kind = F.when(F.col("sub_type") == "ol", "ol").otherwise("ul")
    figure = F.concat(F.lit('<figure><img src="'), xml_attribute(text_of("img_path")), F.lit('" alt="'), xml_attribute(F.col("text")), F.lit('"></figure>'))
    piece = (
        F.when(F.col("type") == "heading", heading).when(F.col("type") == "list", F.concat(F.lit("<"), kind, F.lit(">"), items, F.lit("</"), kind, F.lit(">")))
        .when(F.col("type") == "table", F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))).when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), text, F.lit("</code></pre>")))
        .when(F.col("type") == "image", figure if images != "none" else F.lit("")).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    )
    ink, paper, face = THEMES[theme]
    policy = f"default-src 'none'; style-src 'unsafe-inline'; img-src {IMAGE_SOURCES[images]}"
    head = (
        f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}">'
        f"<style>:root{{--ink:{ink};--paper:{paper};--gap:{SPACING[spacing]}}}body{{color:var(--ink);background:var(--paper);font-family:{face}}}p,li{{margin:var(--gap) 0}}</style></head><body>"
    )
    return _in_order(blocks, key, pos, piece).select(key, F.concat(F.lit(head), "inner", F.lit("</body></html>\n")).alias("html"))


def to_json(blocks: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """key and json: the blocks as one array in order, nulls left out."""
    fields = [c for c in blocks.columns if c not in (key, pos)]
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.to_json(F.struct(*fields)).alias("one"))))
    return blocks.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["one"]), ","), F.lit("]")).alias("json"))
