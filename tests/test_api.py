import pytest

from tests.test_operators import HTML
from vellumix import api
from vellumix.sources import office, word_writer


def test_options_are_checked():
    assert api.Options.of(theme="paper", max_chars=10).max_chars == 10
    for bad in ({"colour": 1}, {"theme": "x"}, {"max_chars": 0}, {"max_chars": True}, {"recursive": "yes"}):
        with pytest.raises(ValueError):
            api.Options.of(**bad)
    assert api.list_formats()["targets"]["markup"] == ["docx", "pdf", "html", "xml"]


def test_a_folder_is_converted(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\nx <y>\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "p.html").write_text(HTML)
    (tmp_path / "sub" / "w.docx").write_bytes(word_writer.written([{"type": "heading", "text": "W", "text_level": 1}, {"type": "list", "list_items": ["i", "j"]}]))
    (tmp_path / "bad.docx").write_bytes(b"no")
    (tmp_path / "skip.txt").write_text("x")
    got = {r.name: bytes(r.content).decode() for r in api.convert(spark, str(tmp_path), "md").collect()}
    assert set(got) == {"a", "p", "w"} and got["w"] == "# W\n\n- i\n\n- j" and got["a"] == "# T\n\nx <y>\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    html = {r.name: bytes(r.content).decode() for r in api.convert(spark, str(tmp_path), "html", theme="night", images="none", recursive=False).collect()}
    assert set(html) == {"a", "p"} and "<th>a</th>" in html["a"] and "x &lt;y&gt;" in html["a"] and "img-src 'none'" in html["a"] and "<img" not in html["p"]
    xml = {r.name: bytes(r.content).decode() for r in api.convert(spark, str(tmp_path), "xml").collect()}
    assert '<heading level="1">T</heading><paragraph>x &lt;y&gt;</paragraph><table><row><cell>a</cell>' in xml["a"]
    docs = api.convert(spark, str(tmp_path), "docx").select("path", "content")
    assert office.read_word(docs).where("error is not null").count() == 0
    with pytest.raises(ValueError):
        api.convert(spark, str(tmp_path), "pdf")


def test_articles_are_cut_but_counted_whole(spark):
    pages = spark.createDataFrame([(1, "https://h/", HTML)], "page_id long, url string, html string")
    r = api.read_articles(spark, pages, max_chars=10).first()
    assert r.truncated and len(r.markdown) == 10 and r.word_count > 10
