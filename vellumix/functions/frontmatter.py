"""Front matter: written as an expression, read with a small scanner."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from vellumix.functions.text import replaced, text_of, trim_ws

#: Fields in their order, each with its key in the header.
FIELDS = (
    ("title", "title"), ("author", "author"), ("publishedAt", "date"), ("source", "source"), ("finalUrl", "finalUrl"),
    ("sourceType", "sourceType"), ("pdfParser", "pdfParser"), ("mineruModel", "mineruModel"), ("siteName", "siteName"),
    ("excerpt", "excerpt"), ("lang", "lang"), ("wordCount", "wordCount"), ("extraction", "extraction"),
    ("fetchedAt", "fetchedAt"), ("convertedAt", "convertedAt"),
)
_CONTROLS = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]


def _quoted(c: Column) -> Column:
    c = replaced(c, (r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"))
    held = c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    escaped = replaced(c, *[(rf"\x{{{k:02x}}}", rf"\\x{k:02x}") for k in _CONTROLS])
    return F.concat(F.lit('"'), F.when(held, escaped).otherwise(c), F.lit('"'))


def built(fields: dict[str, Column]) -> Column:
    """The header of the given fields: numbers bare, texts quoted, empty ones and a finalUrl equal to the source left out."""
    lines = []
    for name, key in FIELDS:
        if name not in fields:
            continue
        value = fields[name]
        if name == "finalUrl" and "source" in fields:
            value = F.when(~value.eqNullSafe(fields["source"]), value)
        if name == "wordCount":
            line = F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value.cast("string")))
        else:
            text = trim_ws(text_of(value.cast("string")))
            line = F.when(text != "", F.concat(F.lit(f"{key}: "), _quoted(text)))
        lines.append(line)
    some = F.array_compact(F.array(*lines))
    return F.when(F.size(some) > 0, F.concat(F.lit("---\n"), F.array_join(some, "\n"), F.lit("\n---\n"))).otherwise("")


_BOM = "\ufeff"
_OPEN = re.compile(f"{_BOM}?---[ \\t]*\\r?\\n")
_CLOSE = re.compile(r"(?:---|\.\.\.)[ \t]*\Z")
_REST = "([^\n\r\u2028\u2029]*)\\Z"
_KEY = re.compile(r"([A-Za-z_][\w.-]*)[ \t]*:[ \t]*" + _REST, re.A)
_ITEM = re.compile(r"[ \t]*-[ \t]+" + _REST)
_ESCAPED = re.compile(r'\\(x[0-9A-Fa-f]{2}|.)', re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t"}


def _unquote(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] == '"':
        def plain(m: re.Match) -> str:
            code = m[1]
            return chr(int(code[1:], 16)) if len(code) == 3 else _NAMED.get(code, code)

        return _ESCAPED.sub(plain, text[1:-1])
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return text


def _items(inner: str) -> Iterator[str]:
    item, quote, skip = "", "", False
    for ch in inner:
        if skip:
            skip = False
        elif quote == '"' and ch == "\\":
            skip = True
        elif quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == ",":
            yield item
            item = ""
            continue
        item += ch
    yield item


def scalar(raw: str) -> object:
    """A list, an integer, a boolean or a text; quoted values stay texts."""
    text = raw.strip()
    if text.startswith("[") and text.endswith("]") and len(text) > 1:
        return [x for x in (_unquote(i.strip()) for i in _items(text[1:-1])) if x]
    if re.fullmatch(r"-?(?:0|[1-9][0-9]*)", text):
        return int(text)
    return {"true": True, "false": False}.get(text, _unquote(text))


def parsed(text: str | None) -> tuple[dict[str, object], str, bool]:
    """Fields, body and whether there was a header."""
    text = text or ""
    if not _OPEN.match(text):
        return {}, text, False
    lines = text.removeprefix(_BOM).split("\n")
    end = next((i for i in range(1, len(lines)) if _CLOSE.match(lines[i].removesuffix("\r"))), None)
    if end is None:
        return {}, text, False
    fields: dict[str, object] = {}
    open_list = None
    for line in (x.removesuffix("\r") for x in lines[1:end]):
        if not line.strip() or line.strip().startswith("#"):
            continue
        item = _ITEM.match(line)
        if item and open_list is not None:
            fields[open_list].append(scalar(item[1]))
            continue
        pair = _KEY.match(line)
        if not pair:
            continue
        if pair[2].strip():
            fields[pair[1]], open_list = scalar(pair[2]), None
        else:
            fields[pair[1]], open_list = [], pair[1]
    return {k: "" if v == [] else v for k, v in fields.items()}, "\n".join(lines[end + 1 :]).lstrip("\n"), True


def parse_frame(texts: pd.Series) -> pd.DataFrame:
    import json

    rows = [parsed(x) for x in texts]
    return pd.DataFrame({"fields": [json.dumps(f, ensure_ascii=False) for f, _, _ in rows], "body": [b for _, b, _ in rows], "found": [k for _, _, k in rows]})


def parse_column(c: Column) -> Column:
    """struct<fields (JSON), body, found> of a text column."""
    return F.pandas_udf(parse_frame, "fields string, body string, found boolean")(c)
