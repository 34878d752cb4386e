import json

from vellumix.sources import markdown, office, word_writer

TEXT = """---
title: x
---

＃Title
para one
continued

Set
---
- a
- b
  more
    - deep

1. one
2. two

| h | i |
|---|:-:|
| 1\\|2 | 3 | 4 |
| x |

```py
# code
```
> quoted
> text

![alt](i/p.png "t")

***
####### seven
end"""


def test_blocks():
    got = [(b["type"], b["text"] if b["type"] != "table" else b["table_rows"]) for b in markdown.blocks(markdown.parsed(TEXT)[1])]
    assert got == [
        ("heading", "Title"), ("text", "para one\ncontinued"), ("heading", "Set"), ("list", "a\nb\nmore\ndeep"), ("list", "one\ntwo"),
        ("table", [["h", "i"], ["1|2", "3"], ["x", ""]]), ("code", "# code"), ("text", "quoted\ntext"), ("image", "alt"), ("text", "####### seven\nend"),
    ]


def test_word_round_trip(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "a\x01b <&>")], "doc_id long, text string")
    read = markdown.read_markdown(docs)
    assert {r.doc_id: json.loads(r.fields) for r in read.collect()}[1] == {"title": "x"}
    files = word_writer.to_word(read).selectExpr("cast(doc_id as string) as path", "content")
    back = office.read_word(files).collect()
    one = [(r.kind, r.text, r.level) for r in back if r.path == "1"]
    assert one[:3] == [("heading", "Title", 1), ("paragraph", "para one\ncontinued", None), ("heading", "Set", 2)]
    assert [r.rows for r in back if r.kind == "table"] == [[["h", "i"], ["1|2", "3"], ["x", ""]]]
    assert [r.text for r in back if r.path == "3"] == ["ab <&>"] and not [r for r in back if r.path == "2"]
    assert word_writer.written([{"type": "text", "text": "x"}]) == word_writer.written([{"type": "text", "text": "x"}])
