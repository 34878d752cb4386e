"""Patent texts: books found by their titles, rendered as XML and read back, all over block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.functions.text import section_title, xml_text
from vellumix.operators import ordered
from vellumix.sources.xml import scan

#: Books and the titles that open them, headings of a description's parts, and issue levels.
BOOKS = {
    "claims": r"\A权利要求书\z", "description": r"\A说明书\z", "drawings": r"\A(?:说明书)?附图\z",
    "abstract": r"\A(?:说明书)?摘要\z", "abstractFigure": r"\A摘要附图\z",
}
PARTS = r"\A(?:技术领域|背景技术|发明内容|实用新型内容|附图说明|具体实施方式|实施例)\z"
BLOCKING = ("PRECHECK_REVISIONS", "PRECHECK_FLOATING_OBJECT", "PRECHECK_TEXTBOX", "PRECHECK_PROTECTION")
TITLE_LENGTH = 12


def book_of(text: Column) -> Column:
    title = section_title(text)
    return F.coalesce(*[F.when(title.rlike(p), F.lit(b)) for b, p in BOOKS.items()])


def with_books(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, pos, kind, text) with their book, the titles themselves left out.

    A heading, or a paragraph of at most twelve characters, whose title names a
    book opens it; blocks before the first title have no book.
    """
    candidate = (F.col("kind") == "heading") | ((F.col("kind") == "paragraph") & (F.length("text") <= TITLE_LENGTH))
    opened = blocks.withColumn("__vx_book", F.when(candidate, book_of(F.col("text"))))
    carried = ordered.carry_forward(opened, "doc", "pos", "__vx_book", "book")
    return carried.where("__vx_book is null").drop("__vx_book")


def missing_books(blocks: DataFrame) -> DataFrame:
    """doc and book of every book that a document lacks, but for the optional abstract figure."""
    spark = blocks.sparkSession
    wanted = spark.createDataFrame([(b,) for b in BOOKS if b != "abstractFigure"], "book string")
    docs = blocks.select("doc").distinct()
    return docs.crossJoin(F.broadcast(wanted)).join(with_books(blocks).select("doc", "book").distinct(), ["doc", "book"], "left_anti")


def _body(text: Column, pattern: str) -> Column:
    return xml_text(F.regexp_replace(text, pattern, ""))


def _book(rows: DataFrame, root: str, piece: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", piece.alias("xml"))))
    inner = F.array_join(F.transform(parts, lambda r: r["xml"]), "\n")
    return rows.groupBy("doc").agg(F.concat(F.lit(f"<{root}>\n"), inner, F.lit(f"\n</{root}>")).alias("xml"))


def render_claims(blocks: DataFrame) -> DataFrame:
    """doc and xml of the claims book: a claim for each number, its continuations as further claim texts."""
    own = ordered.group_claims(with_books(blocks).where("book = 'claims' and kind = 'paragraph'"), "doc", "pos", "text").where("claim_ord > 0")
    texts = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("<claim-text>"), _body(F.col("text"), ordered.CLAIM_START), F.lit("</claim-text>")).alias("x"))))
    claims = own.groupBy("doc", "claim_ord", "claim_num").agg(F.min("pos").alias("pos"), F.array_join(F.transform(texts, lambda r: r["x"]), "").alias("inner"))
    padded = lambda n: F.when(F.length(n.cast("string")) >= 3, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    again = F.row_number().over(Window.partitionBy("doc", "claim_num").orderBy("claim_ord"))
    ident = F.concat(F.lit("cl"), padded(F.when(again == 1, F.col("claim_num")).otherwise(F.col("claim_ord"))))
    claims = claims.withColumn("ident", ident)
    piece = F.concat(F.lit('<claim id="'), "ident", F.lit('" num="'), padded(F.col("claim_num")), F.lit('">'), "inner", F.lit("</claim>"))
    return _book(claims, "claims", piece)


def render_description(blocks: DataFrame) -> DataFrame:
    """doc and xml of the description: part headings, and paragraphs numbered on from their own numbers."""
    own = with_books(blocks).where("book = 'description' and kind in ('paragraph', 'heading')")
    heading = (F.col("kind") == "heading") | section_title(F.col("text")).rlike(PARTS)
    own = own.withColumn("is_heading", heading)
    paragraphs = own.where("not is_heading").withColumn("explicit", ordered.number_of(F.col("text"), ordered.PARAGRAPH_NUMBER))
    numbers = ordered.number_paragraphs(paragraphs, "doc", "pos", "explicit").select("doc", F.col("pos").cast("long").alias("pos"), "value")
    joined = own.withColumn("pos", F.col("pos").cast("long")).join(numbers, ["doc", "pos"], "left")
    num = F.lpad(F.col("value").cast("string"), 4, "0")
    para = F.concat(F.lit('<p id="p'), num, F.lit('" num="'), num, F.lit('">'), _body(F.col("text"), ordered.PARAGRAPH_NUMBER), F.lit("</p>"))
    piece = F.when(F.col("is_heading"), F.concat(F.lit('<heading level="2">'), xml_text(F.col("text")), F.lit("</heading>"))).otherwise(para)
    return _book(joined, "description", piece)


def render_abstract(blocks: DataFrame) -> DataFrame:
    own = with_books(blocks).where("book = 'abstract' and kind = 'paragraph'")
    return _book(own, "abstract", F.concat(F.lit("<p>"), xml_text(F.col("text")), F.lit("</p>")))


def render_drawings(blocks: DataFrame) -> DataFrame:
    """doc and xml of the drawings: a figure for each image, numbered by labels or by count."""
    own = with_books(blocks).where("book = 'drawings'")
    figures = ordered.number_figures(own, "doc", "pos", "kind", "text").withColumn("pos", F.col("pos").cast("long"))
    named = figures.join(own.select("doc", F.col("pos").cast("long").alias("pos"), F.col("text").alias("file")), ["doc", "pos"])
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("pos")).cast("string")
    named = named.withColumn("ident", F.concat(F.lit("f"), F.lpad(nth, 4, "0")))
    piece = F.concat(F.lit('<figure id="'), "ident", F.lit('" num="'), F.lpad(F.col("num").cast("string"), 4, "0"), F.lit('"><img file="'), xml_text(F.col("file")), F.lit('"/></figure>'))
    return _book(named, "drawings", piece)


def render(blocks: DataFrame) -> DataFrame:
    """doc, book and xml of all books that a document has."""
    books = {"claims": render_claims, "description": render_description, "abstract": render_abstract, "drawings": render_drawings}
    out = None
    for book, f in books.items():
        one = f(blocks).select("doc", F.lit(book).alias("book"), "xml")
        out = one if out is None else out.unionByName(one)
    return out


def imported(books: DataFrame) -> DataFrame:
    """doc, book, pos, kind, num and text from rendered books; what isn't well formed is left out."""
    keyed = books.withColumn("doc_book", F.concat_ws("\t", "doc", "book"))
    nodes = scan(keyed, "doc_book", "xml").where("error is null")
    texts = nodes.where("name = '#text'").select("doc_book", F.col("parent_id").alias("node_id"), "value", F.col("node_id").alias("at"))
    texts = texts.groupBy("doc_book", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]), "").alias("text"))
    leaves = nodes.where("name in ('claim-text', 'p', 'heading', 'figure')").join(texts, ["doc_book", "node_id"], "left")
    up = nodes.select("doc_book", F.col("node_id").alias("parent_id"), F.col("attrs").alias("up"))
    joined = leaves.join(up, ["doc_book", "parent_id"], "left")
    num = F.coalesce(F.try_element_at("attrs", F.lit("num")), F.try_element_at("up", F.lit("num"))).cast("long")
    kind = F.when(F.col("name") == "figure", "image").when(F.col("name") == "heading", "heading").otherwise("paragraph")
    part = F.split("doc_book", "\t")
    return joined.select(F.element_at(part, 1).alias("doc"), F.element_at(part, 2).alias("book"), F.col("node_id").alias("pos"), kind.alias("kind"), num.alias("num"), F.coalesce("text", F.lit("")).alias("text"))


def summary(blocks: DataFrame) -> DataFrame:
    """doc, book and how many claims, paragraphs, headings and figures it holds."""
    count = lambda c: F.count_if(c).alias
    rows = with_books(blocks).where("book is not null")
    claim = (F.col("book") == "claims") & ordered.number_of(F.col("text"), ordered.CLAIM_START).isNotNull()
    return rows.groupBy("doc", "book").agg(count(claim)("claims"), count(F.col("kind") == "paragraph")("paragraphs"), count(F.col("kind") == "heading")("headings"), count(F.col("kind") == "image")("figures"))
