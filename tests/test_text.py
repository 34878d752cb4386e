import pytest
from pyspark.sql import functions as F

from vellumix.functions import frontmatter, text as t, web


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


PROBE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def test_white_space(spark):
    assert one(spark, t.squeeze, f"{PROBE}a{PROBE}b{PROBE}", None, PROBE, "\u200ba\u0085") == ["a b", "", "", "\u200ba\u0085"]


def test_normalize(spark):
    got = one(spark, t.normalize_markdown, "a  \r\nb\t\n\n\n\nc\u200b\u00a0d  ", "  \u3000x ", None, "x \ry", "a\u200b \n\u2060\n\nb")
    assert got == ["a\nb\n\nc d", "x", "", "x\ry", "a\n\nb"]
    again = one(spark, t.normalize_markdown, *got)
    assert again == got


def test_words_and_truncation(spark):
    assert one(spark, t.count_words, "中文字 it's well-known カナ 한 é1", None, "caf\u00e9s a'b-c") == [9, 0, 3]
    assert one(spark, lambda c: t.truncate(c, 3), "abc", "abcd", "\U0001f600\U0001f600\U0001f600\U0001f600", None) == ["abc", "abc…", "\U0001f600" * 3 + "…", ""]


def test_strip_html(spark):
    html = "<p>a&nbsp;&lt;b&gt;</p><script>x('</p>')</script><!-- c --><style>q</style> &amp;lt; <br <i>z"
    assert one(spark, t.strip_html, html, None, "<script>open", "1 < 2 > 0")[0] == "a <b> &lt; z"


def test_folder_names(spark):
    got = one(spark, t.folder_name, 'a/b:c*?"<>|d', "  ._x_. ", "CON", "con.txt", "", None, "a" * 150, "nul ", "COMX", "a\x00b\tc")
    assert got == ["a_b_c_d", "x", "CON_", "con_.txt", "untitled", "untitled", "a" * 100, "nul_", "COMX", "abc"]


def test_names_and_extensions(spark):
    assert one(spark, t.strip_extension, "/a/b/report.docx", "x", ".md", "a.tar.gz", None) == ["report", "x", ".md", "a.tar", ""]
    assert one(spark, t.extension, "/a/b.DOCX", "x", ".md", "a.b/c", None) == [".docx", "", "", "", ""]
    assert one(spark, web.input_type, " HTTP://x", "a.PDF", "b.txt", None) == ["url", "pdf", None, None]
    assert one(spark, web.content_type_extension, "image/JPEG; q=1", "x/y", None) == [".jpg", ".png", ".png"]


def test_headings(spark):
    got = one(spark, t.preprocess_headings, "#a\r\n＃＃b\n####### c\n # d\n#", "＃# x")
    assert got == ["# a\n## b\n####### c\n # d\n#", "## x"]


def test_xml_and_cells(spark):
    assert one(spark, t.xml_text, "a<b>&\x01\x0b\ufffe\U0001f600") == ["a&lt;b&gt;&amp;\U0001f600"]
    assert one(spark, t.xml_attribute, 'a"\n') == ["a&quot;&#10;"]
    assert one(spark, t.cell_text, " a |\n b ") == [r"a \| b"]


def test_urls(spark):
    assert one(spark, web.host, "HTTPS://U:p@A.b:8/x", "nope", None, "http://[::1]/") == ["a.b", "", "", "[::1]"]
    assert one(spark, web.leaf_name, "http://h/a/b%20c/", "http://h", "x") == ["b c", "h", "x"]
    assert one(spark, web.image_extension, "http://h/a.PNG?x", "http://h/a.exe", None) == [".png", ".jpg", ".jpg"]


def test_metadata(spark):
    html = """<html lang=' zh '><head><meta content="T" property="og:title"><meta name=author content='http://x'><meta name="twitter:creator" content=" A  B ">
    <meta property="og:site_name" content="S"><meta name="description" content="D d"></head><body><h1>H <b>1</b></h1></body></html>"""
    assert one(spark, web.title, html, "<h1>x</h1>", "") == ["T", "x", "untitled"]
    assert one(spark, web.author, html, "") == ["A B", ""]
    assert one(spark, web.description, html) == ["D d"] and one(spark, web.language, html) == ["zh"]
    assert one(spark, lambda c: web.site_name(c, F.lit("http://h/")), html, "") == ["S", "h"]


def test_attribute_tokens(spark):
    assert one(spark, web.attribute_tokens, "adBanner post-nav__x", "", None) == [["ad", "banner", "post", "nav", "x"], [], []]


CASES = [
    ("\ufeff---\r\ntitle: \"a \\\"b\\\" \\n\"\nn: 12\nb: true\nf: 1.5\nlist: [a, \"b, c\", '']\nitems:\n  - x\n  - 2\nempty:\n# c\nbad\n...\n\n\nbody", {"title": 'a "b" \n', "n": 12, "b": True, "f": "1.5", "list": ["a", "b, c"], "items": ["x", 2], "empty": ""}, "body", True),
    ("---\nx: 1", {}, "---\nx: 1", False), (None, {}, "", False), ("x\n---\n", {}, "x\n---\n", False),
]


@pytest.mark.parametrize(("text", "fields", "body", "found"), CASES)
def test_front_matter_is_read(text, fields, body, found):
    assert frontmatter.parsed(text) == (fields, body, found)


def test_front_matter_is_written(spark):
    rows = spark.createDataFrame([('t "q" \\', 3, "u", "u"), ("", None, "a\nb", "v")], "t string, w int, s string, f string")
    got = [r.h for r in rows.select(frontmatter.built({"finalUrl": F.col("f"), "title": F.col("t"), "wordCount": F.col("w"), "source": F.col("s")}).alias("h")).collect()]
    assert got[0] == '---\ntitle: "t \\"q\\" \\\\"\nsource: "u"\nwordCount: 3\n---\n'
    assert got[1] == '---\nsource: "a\\nb"\nfinalUrl: "v"\n---\n'
    assert frontmatter.parsed(got[0] + "\nx")[0] == {"title": 't "q" \\', "source": "u", "wordCount": 3}
