"""Operators on ordered blocks: numbering, grouping, carrying forward, captions.

Input is always a table of blocks with a document key and a position; results
never rely on partition order.  Windows are per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.functions.text import WS, extension, squeeze, text_of

#: Patterns for numbers, labels and captions of patent texts and articles.
PARAGRAPH_NUMBER = rf"\A[{WS}]*[\[［][{WS}]*([0-9]{{1,6}})[{WS}]*[\]］][{WS}]*"
CLAIM_START = rf"\A[{WS}]*([0-9]+)[{WS}]*[.、．][{WS}]*"
FIGURE_LABEL = rf"\A[{WS}]*图[{WS}]*([0-9]+)[{WS}]*\z"
CAPTION = rf"(?i)\A(?:(?:图|附图|Fig\.?|Figure)[{WS}]*[0-9一二三四五六七八九十]+|图[{WS}]*[|｜:：]|[▲△↑])"
FOOTNOTE = rf"\A(?:注|来源|图源|图片来源|资料来源)[{WS}]*[:：]"
CAPTION_LENGTH, CAPTION_CHAIN = 60, 3


def _running(key: str, pos: str | list[str]):
    return Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def number_of(text: Column, pattern: str) -> Column:
    """The number that a pattern's first group finds, or null."""
    found = F.regexp_extract(text_of(text), pattern, 1)
    return F.when(found != "", found.cast("decimal(18,0)").cast("long"))


def ids_per_prefix(blocks: DataFrame, key: str, prefix: str, pos: str, width: int = 4) -> DataFrame:
    """Counts within document and prefix, zero-padded after the prefix."""
    n = F.row_number().over(Window.partitionBy(key, prefix).orderBy(pos))
    padded = F.when(F.length(n.cast("string")) >= width, n.cast("string")).otherwise(F.lpad(n.cast("string"), width, "0"))
    return blocks.withColumn("block_id", F.concat(F.col(prefix), padded))


def number_paragraphs(blocks: DataFrame, key: str, pos: str, explicit: str, start: int = 1) -> DataFrame:
    """key, pos, value and jump per paragraph: explicit numbers ahead are adopted, those behind ignored, both flagged.

    A value's lead over its rank never falls, so it is the running maximum of the explicit numbers' leads.
    """
    order = Window.partitionBy(key).orderBy(pos, explicit)
    rows = blocks.select(key, F.col(pos).cast("long").alias(pos), F.col(explicit).cast("long").alias(explicit))
    rows = rows.withColumn("__vx_at", F.row_number().over(order).cast("long"))
    own = F.when(F.col(explicit) > 0, F.col(explicit) - F.col("__vx_at"))
    lead = F.greatest(F.max(own).over(Window.partitionBy(key).orderBy("__vx_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(start - 1).cast("long"))
    rows = rows.withColumn("__vx_lead", lead)
    expected = F.col("__vx_at") + F.coalesce(F.lag("__vx_lead").over(Window.partitionBy(key).orderBy("__vx_at")), F.lit(start - 1))
    jump = F.coalesce((F.col(explicit) > 0) & (F.col(explicit) != expected), F.lit(False))
    return rows.select(key, pos, (F.col("__vx_at") + F.col("__vx_lead")).alias("value"), jump.alias("jump"))


def group_claims(blocks: DataFrame, key: str, pos: str | list[str], text: str) -> DataFrame:
    """claim_ord (0: preface) and claim_num: numbered paragraphs open a claim, others join the open one; pos may be several columns."""
    num = number_of(F.col(text), CLAIM_START)
    over = _running(key, pos)
    return blocks.withColumn("claim_ord", F.sum(F.when(num.isNotNull(), 1).otherwise(0)).over(over).cast("long")).withColumn("claim_num", F.last(num, ignorenulls=True).over(over))


def claim_issues(claims: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """One row per document whose claims are not numbered 1..n, with the numbers found in the order of pos, ties as grouped."""
    starts = claims.where(number_of(F.col(text), CLAIM_START).isNotNull())
    found = F.transform(F.array_sort(F.collect_list(F.struct(pos, "claim_ord", "claim_num"))), lambda s: s["claim_num"])
    return starts.groupBy(key).agg(F.count("*").alias("n_claims"), F.bool_and(F.col("claim_ord") == F.col("claim_num")).alias("ok"), found.alias("nums")).where(~F.col("ok")).select(key, "n_claims", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"))


def carry_forward(blocks: DataFrame, key: str, pos: str, value: str, into: str) -> DataFrame:
    """The last value that was not null, up to this row."""
    return blocks.withColumn(into, F.last(value, ignorenulls=True).over(_running(key, pos)))


def islands(blocks: DataFrame, key: str, pos: str, group: str, into: str = "island") -> DataFrame:
    """Number runs of neighbours that share a group; a null group never joins its neighbour."""
    before = F.lag(group).over(Window.partitionBy(key).orderBy(pos))
    start = F.when(F.col(group).isNotNull() & (F.col(group) == before), 0).otherwise(1)
    return blocks.withColumn("__vx_start", start).withColumn(into, F.sum("__vx_start").over(_running(key, pos)).cast("long")).drop("__vx_start")


def caption_kind(text: Column) -> Column:
    """image_footnote, caption or null for a paragraph's text."""
    text = squeeze(text)
    short = (text != "") & (F.length(text) <= CAPTION_LENGTH)
    return F.when(short & text.rlike(FOOTNOTE), "image_footnote").when(short & text.rlike(CAPTION), "caption")


def mark_captions(blocks: DataFrame, key: str, pos: str, kind: str, text: str) -> DataFrame:
    """role for up to three caption or footnote paragraphs right after an image; anything else ends the chain."""
    own = F.when(F.col(kind) == "paragraph", caption_kind(F.col(text)))
    order = Window.partitionBy(key).orderBy(pos)
    marked = blocks.withColumn("__vx_own", own).withColumn("__vx_at", F.row_number().over(order))
    stops = F.when(F.col("__vx_own").isNull(), F.struct("__vx_at", F.col(kind).alias("kind")))
    last = F.last(stops, ignorenulls=True).over(_running(key, pos))
    marked = marked.withColumn("__vx_last", last)
    since = F.col("__vx_at") - F.col("__vx_last.__vx_at")
    role = F.when((F.col("__vx_last.kind") == "image") & since.between(1, CAPTION_CHAIN), F.col("__vx_own"))
    return marked.withColumn("role", role).drop("__vx_own", "__vx_at", "__vx_last")


def number_figures(blocks: DataFrame, key: str, pos: str, kind: str, text: str) -> DataFrame:
    """key, pos and num of each image: a label before or right after names it, others count on.

    Only the gaps between images matter: an image without a label before it takes
    the first one after it, and the last label left in a gap is the next image's.
    A gap of none leaves the next image open, one of several names it, and one of
    a single label passes on whether the image before was open.
    """
    num = number_of(F.col(text), FIGURE_LABEL)
    rows = blocks.select(key, F.col(pos).cast("long").alias(pos), (F.col(kind) == "image").alias("image"), num.alias("num")).where("image or (not image and num is not null)")
    order = Window.partitionBy(key).orderBy(pos, F.desc("image"), "num")
    rows = rows.withColumn("seq", F.count_if("image").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("at", F.struct(F.col(pos), "num"))
    label = F.when(~F.col("image"), F.col("at"))
    gaps = rows.groupBy(key, "seq").agg(
        F.max(F.when(F.col("image"), F.col(pos))).alias(pos), F.count(label).alias("n"), F.min(label)["num"].alias("first"), F.max(label)["num"].alias("last"),
    )
    by_seq = Window.partitionBy(key).orderBy("seq")
    before = F.coalesce(F.lag("n").over(by_seq), F.lit(0))
    images = gaps.select("*", before.alias("before"), F.lag("last").over(by_seq).alias("pending")).where("seq > 0")
    up_to = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.coalesce(F.last(F.when(F.col("before") == 0, True).when(F.col("before") > 1, False), ignorenulls=True).over(up_to), F.lit(False))
    own = images.withColumn("own", F.when(open_, F.col("first")).otherwise(F.col("pending")))
    base = F.last(F.when(F.col("own").isNotNull(), F.col("own") - F.col("seq")), ignorenulls=True).over(up_to)
    return own.select(key, pos, (F.col("seq") + F.coalesce(base, F.lit(0))).alias("num"))


def trailing_figures(blocks: DataFrame, key: str, pos: str, kind: str, text: str) -> DataFrame:
    """Blocks with trailing: whether a block is in the longest end of images and bare figure labels that holds an image; ties go together."""
    part = F.coalesce((F.col(kind) == "image") | ((F.col(kind) == "paragraph") & number_of(F.col(text), FIGURE_LABEL).isNotNull()), F.lit(False))
    back = Window.partitionBy(key).orderBy(F.desc(pos)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = blocks.withColumn("__vx_part", F.bool_and(part).over(back))
    image = F.bool_or(F.col("__vx_part") & F.coalesce(F.col(kind) == "image", F.lit(False))).over(Window.partitionBy(key))
    return marked.withColumn("trailing", F.col("__vx_part") & image).drop("__vx_part")


def book_files(uses: DataFrame, assets: DataFrame, book: str, pos: str, name: str) -> DataFrame:
    """book, name, file of each asset that a book uses: the book's code and the rank of first use; unknown names are left out."""
    known = assets.select(F.col(name).alias("__vx_name")).where("__vx_name <> ''").distinct()
    first = uses.where(F.col(book).rlike(r"\A[0-9A-Za-z]+\z")).groupBy(book, name).agg(F.min(pos).alias("__vx_first"))
    first = first.join(known, first[name] == known["__vx_name"], "left_semi")
    seq = F.row_number().over(Window.partitionBy(book).orderBy("__vx_first", name)).cast("string")
    ext = F.coalesce(F.nullif(extension(F.col(name)), F.lit("")), F.lit(".jpg"))
    return first.select(book, name, F.concat(F.col(book), F.lit("_"), seq, ext).alias("file"))


def fenced(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """inside: whether a line is within or delimits a ``` fence, by the parity of fence lines before it."""
    is_fence = F.col(line).rlike(r"\A {0,3}```")
    count = F.sum(F.when(is_fence, 1).otherwise(0)).over(_running(key, pos))
    return lines.withColumn("inside", is_fence | (count % 2 == 1))


def increasing_only(events: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Events whose value exceeds everything before them."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("__vx_before", before).where(F.col("__vx_before").isNull() | (F.col(value) > F.col("__vx_before"))).drop("__vx_before")


def numbered_by_first_use(uses: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """image_no: the rank of each name by its first use in the document."""
    first = F.min(pos).over(Window.partitionBy(key, name))
    return uses.withColumn("__vx_first", first).withColumn("image_no", F.dense_rank().over(Window.partitionBy(key).orderBy("__vx_first")).cast("long")).drop("__vx_first")
