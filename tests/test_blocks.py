"""Window forms beside plain loops, and the edges of addresses, dates and headings."""

import random

from pyspark.sql import functions as F

from vellumix.functions import text as t, web
from vellumix.operators import ordered


def test_figures_and_paragraphs_as_in_a_loop(spark):
    rnd, rows = random.Random(7), []
    for doc in range(60):
        for pos in range(rnd.randrange(12)):
            kind = rnd.choice(["image", "image", "paragraph", "paragraph", "table", None])
            rows.append((doc, pos, kind, rnd.choice(["图 3", "图7", "words", None, ""]), rnd.choice([None, 0, -2, 1, 4, 9])))
    df = spark.createDataFrame(rows, "doc int, pos int, kind string, text string, ex int")
    figures, numbers, trailing = {}, {}, {}
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        out, pending, open_, upcoming, following = [], None, False, 1, 1
        for _, pos, kind, text, ex in own:
            label = int(text[-1]) if text and text.startswith("图") else None
            if kind == "image":
                out.append([pos, pending])
                open_, pending = pending is None, None
            elif kind and label is not None and open_:
                out[-1][1], open_ = label, False
            elif kind and label is not None:
                pending = label
            value = ex if ex and ex > following else following
            numbers[doc, pos] = (value, bool(ex and ex > 0 and ex != following))
            following = value + 1
        for pos, num in out:
            figures[doc, pos] = num if num is not None else upcoming
            upcoming = figures[doc, pos] + 1
        end = len(own)
        while end and (own[end - 1][2] == "image" or (own[end - 1][2] == "paragraph" and (own[end - 1][3] or "").startswith("图"))):
            end -= 1
        holds = any(r[2] == "image" for r in own[end:])
        trailing.update({(doc, r[1]): holds and n >= end for n, r in enumerate(own)})
    assert {(r.doc, r.pos): r.num for r in ordered.number_figures(df, "doc", "pos", "kind", "text").collect()} == figures
    assert {(r.doc, r.pos): (r.value, r.jump) for r in ordered.number_paragraphs(df, "doc", "pos", "ex").collect()} == numbers
    assert {(r.doc, r.pos): r.trailing for r in ordered.trailing_figures(df, "doc", "pos", "kind", "text").collect()} == trailing


def column(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    return [r.x for r in df.select("id", function(F.col("v")).alias("x")).orderBy("id").collect()]


def test_addresses(spark):
    private = ["::", "::1", "[::1]", "fc00::1", "fdff::", "fe80::1%eth0", "febf::", "::ffff:10.0.0.1", "::127.0.0.1", "2002:7f00:1::", "64:ff9b::c0a8:1", "1::2::3", "x", "", None, "1:2:3:4:5:6:7", "::ffff:256.1.1.1", "1:2:3:4:5:6:7:8:9", "10.0.0.1", "1:2:3:4:5:6:7::8", "12345::", ":1:2:3:4:5:6:7"]
    public = ["2001:db8::1", "fec0::1", "::ffff:8.8.8.8", "2002:808:808::", "64:ff9b::8.8.8.8", "64:ff9b:1::10.0.0.1", "8.8.8.8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "::2:0:0:0:0:0:0"]
    got = column(spark, web.private_address, private + public)
    assert got == [True] * len(private) + [False] * len(public)


def test_dates(spark):
    pairs = {"2024-02-03": "2024-02-03T00:00:00.000Z", " 2024-02-03T04:05Z ": "2024-02-03T04:05:00.000Z", "2024-02-03 04:05:06.789+0100": "2024-02-03T03:05:06.789Z", "2024": "2024-01-01T00:00:00.000Z", "Sat, 03 Feb 2024 04:05:06 GMT": "2024-02-03T04:05:06.000Z", "Feb 3, 2024": "2024-02-03T00:00:00.000Z", "February 13, 2024": "2024-02-13T00:00:00.000Z", "soon": "", "": "", None: "", "2024-13-01": ""}
    assert column(spark, t.iso_time, list(pairs)) == list(pairs.values())


def test_headings(spark):
    pairs = {"**Bold** and `code`": "Bold and code", "[a](b) ![c](d) [e][f]": "a c e", "x <b>y</b>  z": "x y z", "_it_ and *em* snake_case_name": "it and em snake_case_name", r"1\. A \* B": "1. A * B", "a &amp; b&nbsp;c &#65; &#x42;": "a & b c A B", None: "", "": ""}
    assert column(spark, t.plain_heading, list(pairs)) == list(pairs.values())
    assert column(spark, t.heading_key, ["Ａbc 12-３!", "Été d'x", "ﬁ ①", None]) == ["abc123", "étédx", "fi1", ""]
    assert column(spark, t.title_field, ["发明名称：一种 装置 ", " 发明 名称:x", "实用新型名称 y", "名称：z", "发明名称：a\nb", "发明名称：", None]) == ["一种 装置", None, "y", None, None, None, None]
