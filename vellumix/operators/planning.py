"""Planning and bookkeeping around conversions, as tables: targets, inputs, outputs, tallies, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.functions.text import squeeze, text_of
from vellumix.functions.web import input_type

#: Classes of input types, and which classes each target takes.
INPUT_CLASS = {"docx": "office", "xlsx": "office", "pptx": "office", "pdf": "office", "md": "markup", "xml": "markup", "zip": "markup", "url": "url"}
DEFAULT_TARGET = {"office": "bundle", "markup": "docx", "url": "bundle"}
TARGETS = {
    "bundle": (("office", "url"), "folder", "md"), "docx": (("markup",), "single", "docx"), "pdf": (("markup",), "single", "pdf"),
    "html": (("office", "markup", "url"), "folder", "html"), "xml": (("office", "markup", "url"), "folder", "xml"),
}
BOOK_KEYS = {"100001": "claims", "100002": "description", "100003": "drawings", "100004": "abstract", "100005": "abstractFigure"}
DETAILS, DETAIL_LENGTH, REPORT_LINES = 8, 40, 200


def target_matrix(types: DataFrame, pdf: bool = True) -> DataFrame:
    """type, target, layout and ext for every target that a type's class takes; pdf only with a back end."""
    spark = types.sparkSession
    rules = [(c, t, layout, ext) for t, (classes, layout, ext) in TARGETS.items() if pdf or t != "pdf" for c in classes]
    classes = spark.createDataFrame(list(INPUT_CLASS.items()), "type string, class string")
    return types.join(F.broadcast(classes), "type").join(F.broadcast(spark.createDataFrame(rules, "class string, target string, layout string, ext string")), "class")


def resolved_target(kind: Column, requested: Column) -> Column:
    """The requested target if the type's class takes it, the class's default without a request, else null."""
    out = F.lit(None).cast("string")
    for t, c in INPUT_CLASS.items():
        allowed = [name for name, (classes, _, _) in TARGETS.items() if c in classes]
        own = F.when(text_of(requested) == "", F.lit(DEFAULT_TARGET[c])).when(requested.isin(*allowed), requested)
        out = F.when(kind == t, own).otherwise(out)
    return out


def classified(inputs: DataFrame, bundles: DataFrame, column: str = "value") -> DataFrame:
    """inputs with type: url, xml for a listed bundle directory, by extension, or null."""
    listed = bundles.select(F.col("dir").alias("__vx_dir")).distinct()
    joined = inputs.join(F.broadcast(listed), inputs[column] == listed["__vx_dir"], "left")
    kind = input_type(F.col(column))
    return joined.withColumn("type", F.when(kind == "url", kind).when(F.col("__vx_dir").isNotNull(), "xml").otherwise(kind)).drop("__vx_dir")


def expanded(explicit: DataFrame, found: DataFrame) -> DataFrame:
    """dir, path and the directory's count: files found in directories, less those given explicitly."""
    rest = found.join(explicit.select("path").distinct(), "path", "left_anti")
    return rest.withColumn("n_in_dir", F.count("*").over(Window.partitionBy("dir")))


def scan_order(paths: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """Distinct paths in code-point order cut to `most`, and whether any are left over."""
    ordered = paths.select("path").distinct().orderBy("path")
    return ordered.limit(most), F.count("*") > most


def url_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, url and status (ok, duplicate or why not) of every line that isn't blank."""
    rows = texts.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("line", "raw"))
    rows = rows.select(key, (F.col("line") + 1).cast("long").alias("line"), squeeze(F.col("raw")).alias("url")).where("url <> ''")
    why = F.when(~F.col("url").rlike(r"(?i)\Ahttps?://"), "scheme").when(F.length("url") > 4096, "too long").when(~F.col("url").rlike(r"(?i)\Ahttps?://[^\s/?#:@]+(?::[0-9]{1,5})?(?:[/?#][^\s]*)?\z"), "malformed")
    rows = rows.withColumn("why", why)
    again = F.row_number().over(Window.partitionBy(key, "url").orderBy("line")) > 1
    return rows.withColumn("status", F.coalesce("why", F.when(again, "duplicate").otherwise("ok"))).drop("why")


def output_key(name: Column) -> Column:
    """The key under which an output file is reported: book, extension, sidecar or camel-cased stem."""
    path = F.regexp_replace(name, r"\\", "/")
    book = F.regexp_extract(path, r"\A(\d{6})/\1\.xml\z", 1)
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(base, r"(?s)\A.+(\.[^.]*)\z", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    sidecar = F.substring(stem, len("{name}_") + 1, 1 << 20)
    tail = F.lower(F.substring(ext, 2, 1 << 20))
    suffix = F.when((ext == "") | (tail == "json"), "").otherwise(F.concat(F.upper(F.substring(tail, 1, 1)), F.substring(tail, 2, 1 << 20)))
    books = F.coalesce(*[F.when(book == k, F.lit(v)) for k, v in BOOK_KEYS.items()])
    side = F.when(camel_case(sidecar) == "", "file").otherwise(F.concat(camel_case(sidecar), suffix))
    plain = F.coalesce(F.nullif(camel_case(stem), F.lit("")), F.nullif(camel_case(base), F.lit("")), F.lit("file"))
    return F.coalesce(books, F.when((stem == "{name}") & (ext != ""), tail).when(stem.startswith("{name}_") & (sidecar != ""), side).otherwise(plain))


def camel_case(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    cap = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
    low = lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, low(p)).otherwise(cap(p))), "")


def path_map(images: DataFrame) -> DataFrame:
    """from_path and to_path: the first mapping of each source path, and of its base name unless that maps itself."""
    named = images.where("from_path is not null and to_path is not null and from_path <> '' and to_path <> '' and from_path <> to_path")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = named.where(base("from_path") != F.col("from_path")).select((F.col("ord") + F.lit(0.5)).alias("ord"), base("from_path").alias("from_path"), base("to_path").alias("to_path"))
    both = named.select(F.col("ord").cast("double").alias("ord"), "from_path", "to_path").union(bare)
    return both.groupBy("from_path").agg(F.min_by("to_path", "ord").alias("to_path"))


def rewritten(values: DataFrame, mapping: DataFrame, column: str = "value") -> DataFrame:
    """Values replaced where the whole value is mapped."""
    right = mapping.select(F.col("from_path").alias("__vx_from"), F.col("to_path").alias("__vx_to"))
    return values.join(right, values[column] == right["__vx_from"], "left").withColumn(column, F.coalesce("__vx_to", column)).drop("__vx_from", "__vx_to")


def tally(results: DataFrame, status: str = "status") -> DataFrame:
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("succeeded", "failed", "cancelled")]
    return results.agg(*counts)


def loss_report(losses: DataFrame) -> DataFrame:
    """kind, total and details: the eight commonest clipped details, most first, with a mark if there are more."""
    clip = F.substring(squeeze(F.col("detail")), 1, DETAIL_LENGTH)
    counted = losses.select("kind", clip.alias("detail")).groupBy("kind", "detail").agg(F.count("*").alias("n"))
    per = counted.groupBy("kind").agg(F.sum("n").alias("total")).withColumnRenamed("kind", "k")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "detail"))
    # one more than is shown tells whether there are more; Spark cuts each partition to these before the shuffle
    top = counted.where("detail <> ''").withColumn("place", place).where(F.col("place") <= DETAILS + 1)
    lists = top.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "n", "detail"))).alias("all"))
    one = lambda d: F.concat(d["detail"], F.when(d["n"] > 1, F.concat(F.lit("×"), d["n"].cast("string"))).otherwise(""))
    details = F.concat(F.array_join(F.transform(F.slice("all", 1, DETAILS), one), ", "), F.when(F.size("all") > DETAILS, F.lit(" …")).otherwise(""))
    return per.join(lists, per["k"].eqNullSafe(lists["kind"]), "left").select(F.col("k").alias("kind"), "total", F.coalesce(details, F.lit("")).alias("details"))


def capped(lines: DataFrame, key: str, order: str, line: str, most: int = REPORT_LINES) -> DataFrame:
    """Lines, each text once in its first place, cut to most with the last line counting the rest."""
    first = lines.groupBy(key, line).agg(F.min(order).alias(order))
    totals = first.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("total"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    ranked = first.withColumn("n", n).where(F.col("n") <= most).withColumn("n", F.col("n").cast("long"))
    ranked = ranked.join(totals, ranked[key].eqNullSafe(totals["k"]))
    over = (F.col("total") > most) & (F.col("n") == most)
    return ranked.select(key, "n", F.when(over, F.concat(F.lit("more: "), (F.col("total") - most + 1).cast("string"))).otherwise(F.col(line)).alias(line))


def near_captions(captions: DataFrame, paragraphs: DataFrame, reach: int = 3) -> DataFrame:
    """caption and the nearest paragraph of equal squeezed text within reach: next, previous, next but one, ..."""
    c = captions.select("doc", "caption_id", F.col("pos").alias("at"), squeeze(F.col("text")).alias("norm"))
    p = paragraphs.select("doc", "pos", squeeze(F.col("text")).alias("norm"))
    gap = F.col("pos") - F.col("at")
    met = c.join(p, ["doc", "norm"]).where(gap.between(-reach, reach) & (gap != 0) & (F.col("norm") != ""))
    rank = F.abs(gap) * 2 - F.when(gap > 0, 1).otherwise(0)
    return met.groupBy("doc", "caption_id").agg(F.min_by("pos", rank).alias("pos"))


def layout(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The first block of each image path with its page's size and its box in pixels (points to 96 dpi)."""
    first = blocks.groupBy("doc", "img_path").agg(F.min_by(F.struct("page_idx", "x0", "y0", "x1", "y1"), "pos").alias("b")).select("doc", "img_path", "b.*")
    sized = first.join(pages, ["doc", "page_idx"], "left")
    px = lambda a, b, side: F.floor((F.col(b) - F.col(a)) / 1000 * F.col(side) * 96 / 72 + 0.5).cast("long")
    return sized.select("doc", "img_path", "page_idx", px("x0", "x1", "page_w").alias("w_px"), px("y0", "y1", "page_h").alias("h_px"))


def file_role(name: Column) -> Column:
    """What a file of an analysis package is."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return (
        F.when(base.endswith("content_list.json"), "content_list").when(base.endswith("content_list_v2.json"), "content_list_v2").when(base.endswith("model.json"), "model")
        .when(base.endswith("layout.json") | base.endswith("middle.json"), "layout").when(base.endswith("origin.pdf"), "origin").when(base.endswith(".md"), "markdown")
        .when(base.rlike(r"\.(?:png|jpe?g|gif|bmp|webp|tiff?)\z"), "image").otherwise("other")
    )


def text_lines(items: DataFrame) -> DataFrame:
    """Lines of positioned text: items of a page whose y rounds to the same even step, left to right, with the mean size."""
    bucket = F.floor(F.col("y") / 2 + 0.5)
    parts = F.array_sort(F.collect_list(F.struct("x", "str")))
    lines = items.groupBy("doc", "page", bucket.cast("long").alias("bucket")).agg(F.array_join(F.transform(parts, lambda p: p["str"]), " ").alias("line"), F.avg("size").alias("size"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.col("bucket").desc())).cast("long"))


def headings(lines: DataFrame, factor: float = 1.4, most: int = 80) -> DataFrame:
    """heading: lines under `most` characters whose size is `factor` times the document's median or more."""
    median = lines.groupBy("doc").agg(F.percentile("size", F.lit(0.5)).alias("median"))
    return lines.join(median, "doc").withColumn("heading", (F.col("size") >= F.col("median") * factor) & (F.length("line") < most))


def rectangle(rows: DataFrame) -> DataFrame:
    """Cells of every row padded with empty ones to the sheet's widest row."""
    width = F.max(F.size("cells")).over(Window.partitionBy("sheet"))
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), (width - F.size("cells")).cast("int"))))


def commonest_size(sizes: DataFrame) -> DataFrame:
    """Per document the most frequent size; of equally frequent ones the larger."""
    counted = sizes.groupBy("doc", "size").agg(F.count("*").alias("n"))
    return counted.groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("size"))


def style_values(styles: DataFrame, most_depth: int = 12) -> DataFrame:
    """style and value: its own, or that of the nearest style that it is based on."""
    base = styles.select(F.col("style").alias("p_style"), F.col("based_on").alias("p_based"), F.col("value").alias("p_value"))
    out = styles.select("style", F.col("based_on").alias("up"), "value")
    for _ in range(most_depth):
        joined = out.join(base, F.col("up") == F.col("p_style"), "left")
        out = joined.select("style", F.when(F.col("value").isNull(), F.col("p_based")).alias("up"), F.coalesce("value", "p_value").alias("value"))
    return out.select("style", "value")


def contained(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points with the ranges of their document that hold them: start <= pos < end."""
    return points.join(ranges, (points["doc"] == ranges["doc"]) & (points["pos"] >= ranges["start"]) & (points["pos"] < ranges["end"])).select(points["doc"], "pos", "role")


def emu_to_px(emu: Column) -> Column:
    return F.floor(emu / 9525 + F.lit(0.5)).cast("long")


def emu_to_mm(emu: Column) -> Column:
    return emu / 36000


def px_to_mm(px: Column, dpi: Column) -> Column:
    """Whole millimetres, one at least; 25.4 is taken as 254 tenths, so that a whole quotient stays whole."""
    return F.greatest(F.floor(px * F.lit(254.0) / (dpi * 10)), F.lit(1)).cast("long")


def warnings_in_order(*stages: Column) -> Column:
    """The warnings of all stages one after the other; order and repeats stay."""
    return F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in stages])


def parts_problem(parts: Column, allowed: tuple[str, ...] = tuple(BOOK_KEYS.values())) -> Column:
    """Null for a list of parts that is not empty, repeats none and names allowed ones only; else what is wrong."""
    return (
        F.when(parts.isNull() | (F.size(parts) <= 0), "empty").when(F.size(F.array_distinct(parts)) != F.size(parts), "repeated")
        .when(~F.coalesce(F.forall(parts, lambda p: p.isin(*allowed)), F.lit(False)), "unknown")
    )


def sized_images(images: DataFrame, layout: DataFrame, path: str = "source_path") -> DataFrame:
    """images with display: the size that the layout gives their path, where it has one (the first of several, the least of ties)."""
    first = layout.where(F.col("display").isNotNull()).groupBy(F.col(path).alias("__vx_path")).agg(F.min(F.struct("ord", "display"))["display"].alias("display"))
    return images.join(first, images[path] == first["__vx_path"], "left").drop("__vx_path")


def distinct_names(uses: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """key and names: a document's names, each once, in the order of first use."""
    first = uses.where(F.col(name) != "").groupBy(key, name).agg(F.min(pos).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda s: s[name]).alias("names"))
