"""Display sizes, indents and image lines of web pages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.functions.text import WS, text_of
from vellumix.functions.web import host_within

#: The column width of one host's pages, and the font size that lengths fall back to.
COLUMN_HOST, COLUMN_PX = "mp.weixin.qq.com", 677
FONT_PX, MOST_INDENT = 16.0, 4
_NUMBER = r"([0-9]{1,5}(?:\.[0-9]+)?)"


def _round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def _dimension(raw: Column) -> Column:
    """struct<value, unit> of a length in px or %, or null."""
    found = rf"(?i)\A[{WS}]*{_NUMBER}[{WS}]*(px|%)?[{WS}]*\z"
    value = F.regexp_extract(text_of(raw), found, 1)
    unit = F.when(F.regexp_extract(text_of(raw), found, 2) == "%", "%").otherwise("px")
    number = F.when(value != "", value).cast("double")
    return F.when((number > 0) & ((unit == "px") | (number <= 100)), F.struct(number.alias("value"), unit.alias("unit")))


def _styled(style: Column, name: str) -> Column:
    found = rf"(?i)(?:\A|;)[{WS}]*{name}[{WS}]*:[{WS}]*{_NUMBER}[{WS}]*(px|%)"
    return _dimension(F.concat(F.regexp_extract(text_of(style), found, 1), F.regexp_extract(text_of(style), found, 2)))


def _px(d: Column) -> Column:
    return F.when(d["unit"] == "px", d)


def display_size(width: Column, height: Column, style: Column, data_w: Column, host: Column) -> Column:
    """An image's size as WIDTHxHEIGHT, WIDTH or N%, or null: by attribute, style, or (on one host) its natural width."""
    fixed = host_within(F.lower(text_of(host)), COLUMN_HOST)
    w = F.coalesce(_dimension(width), _styled(style, "width"), F.when(fixed, _px(_dimension(data_w))))
    h = F.when(w["unit"] == "px", F.coalesce(_px(_dimension(height)), _px(_styled(style, "height"))))
    percent = (w["unit"] == "%") & ~fixed
    px = F.when(w["unit"] == "%", _round(w["value"] * COLUMN_PX / 100)).otherwise(_round(w["value"]))
    wide = fixed & (w["unit"] == "px") & (px > COLUMN_PX)
    tall = F.coalesce(_round(h["value"]), F.lit(0))
    tall = F.when(wide, _round(tall * COLUMN_PX / px)).otherwise(tall)
    px = F.when(wide, F.lit(COLUMN_PX)).otherwise(px).cast("long")
    sized = F.when(px >= 1, F.when(tall >= 1, F.concat_ws("x", px.cast("string"), tall.cast("string"))).otherwise(px.cast("string")))
    hundredths = F.regexp_replace((_round(w["value"] * 100) / 100).cast("string"), r"\.0\z", "")
    return F.when(percent, F.concat(hundredths, F.lit("%"))).otherwise(sized)


def style_indent(styles: Column) -> Column:
    """First-line indent in characters (1 to 4, or 0) from styles of an element and its ancestors, nearest first."""
    found = rf"(?i)(?:\A|;)[{WS}]*text-indent[{WS}]*:[{WS}]*(-?[0-9]+(?:\.[0-9]+)?)[{WS}]*(?:(em|rem|px)[{WS}]*)?(?:!important[{WS}]*)?(?:;|\z)"
    size = rf"(?i)(?:\A|;)[{WS}]*font-size[{WS}]*:[{WS}]*([0-9]+(?:\.[0-9]+)?)px"
    nearest = F.try_element_at(F.filter(styles, lambda s: s.rlike(found)), F.lit(1))
    value, unit = F.regexp_extract(nearest, found, 1), F.lower(F.regexp_extract(nearest, found, 2))
    number = F.when(value != "", value).cast("double")
    sizes = F.transform(F.filter(styles, lambda s: s.rlike(size)), lambda s: F.regexp_extract(s, size, 1).cast("double"))
    font = F.coalesce(F.try_element_at(F.filter(sizes, lambda x: x > 0), F.lit(1)), F.lit(FONT_PX))
    chars = F.when(unit == "em", number).when(unit == "rem", number * FONT_PX / font).when(unit == "px", number / font)
    return F.when((number > 0) & (_round(chars) >= 1), F.least(_round(chars), F.lit(MOST_INDENT))).otherwise(0).cast("long")


def isolate_images(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and text, with blank lines around lines that are one img tag, but for those in code fences.

    A blank line goes between two lines that aren't blank if either is such an image.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    fence = F.col("line").rlike(rf"\A[{WS}]{{0,3}}(?:```|~~~)")
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1
    marked = lines.withColumn("lone", ~inside & F.col("line").rlike(r"\A<img\b[^<>\n]*>[ \t]*\z")).withColumn("filled", F.col("line").rlike(rf"[^{WS}]"))
    gap = F.lag("filled").over(order) & F.col("filled") & (F.lag("lone").over(order) | F.col("lone"))
    marked = marked.withColumn("line", F.when(gap, F.concat(F.lit("\n"), "line")).otherwise(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("at", "line")))
    return marked.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias(text))
