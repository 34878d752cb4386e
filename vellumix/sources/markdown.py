"""Markdown texts as typed blocks: a line-based reader of the common block grammar and pipe tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumix.functions.frontmatter import parsed
from vellumix.session import ship

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)\Z")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?\Z")
_QUOTE = re.compile(r" {0,3}>[ ]?(.*)\Z")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)\Z")


def prepared(text: str) -> str:
    """LF line ends, full-width number signs and tight headings put right."""
    text = text.replace("\r\n", "\n")
    text = re.sub("(?m)^([#＃]{1,6})(?![#＃])", lambda m: "#" * len(m[0]), text)
    return re.sub(r"(?m)^(#{1,6})(?=[^#\s])", r"\1 ", text)


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def blocks(text: str) -> list[dict]:
    """Headings, paragraphs, lists, tables, code and lone images in order; quotes are flattened, rules give nothing."""
    out: list[dict] = []
    lines = prepared(text).split("\n")
    para: list[str] = []
    items: list[str] = []
    kind = ""

    def end_paragraph() -> None:
        if para:
            joined = "\n".join(x.strip() for x in para)
            image = _IMAGE.match(joined)
            out.append({"type": "image", "text": image[1], "img_path": image[2]} if image else {"type": "text", "text": joined})
            para.clear()

    def end_list() -> None:
        if items:
            out.append({"type": "list", "text": "\n".join(items), "list_items": list(items), "sub_type": kind})
            items.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = _FENCE.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            end_paragraph(), end_list()
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*\Z")
            end = next((j for j in range(i + 1, len(lines)) if close.match(lines[j])), len(lines))
            out.append({"type": "code", "text": "\n".join(lines[i + 1 : end]), "sub_type": fence[2].strip().split(" ")[0]})
            i = end + 1
            continue
        atx, item, quote = _ATX.match(line), _ITEM.match(line), _QUOTE.match(line)
        if not line.strip():
            end_paragraph()
            ahead = next((x for x in lines[i + 1 :] if x.strip()), "")
            if items and not (_ITEM.match(ahead) or ahead[:1] in (" ", "\t")):
                end_list()
        elif atx:
            end_paragraph(), end_list()
            if (atx[2] or "").strip("# \t"):
                out.append({"type": "heading", "text": atx[2].strip(), "text_level": len(atx[1])})
        elif para and _SETEXT.match(line):
            out.append({"type": "heading", "text": " ".join(x.strip() for x in para), "text_level": 1 if "=" in line else 2})
            para.clear()
        elif _RULE.match(line):
            end_paragraph(), end_list()
        elif not para and "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            end_list()
            rows, i = [_cells(line)], i + 2
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                row = _cells(lines[i])[: len(rows[0])]
                rows.append(row + [""] * (len(rows[0]) - len(row)))
                i += 1
            out.append({"type": "table", "text": "", "table_rows": rows})
            continue
        elif item and (not para or items):
            end_paragraph()
            own = "ul" if item[2] in "-*+" else "ol"
            if items and own != kind:
                end_list()
            kind = own
            items.append((item[3] or "").strip())
        elif quote and not items:
            para.append(quote[1])
        elif items and line[:1] in (" ", "\t"):
            nested = _ITEM.match(line.strip())
            if nested:
                items.append((nested[3] or "").strip())
            else:
                items[-1] += "\n" + line.strip()
        elif items and lines[i - 1].strip():
            items[-1] += "\n" + line.strip()
        else:
            end_list()
            para.append(line)
        i += 1
    end_paragraph(), end_list()
    return out


def read_markdown(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, fields of the front matter and blocks, both as JSON."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, found = [], []
            for text in batch.column(column).to_pylist():
                own, body, _ = parsed(text)
                fields.append(json.dumps(own, ensure_ascii=False))
                found.append(json.dumps(blocks(body), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fields, pa.string()), pa.array(found, pa.string())], names=[key, "fields", "blocks"])

    return texts.select(key, column).mapInArrow(run, f"{key} {kind}, fields string, blocks string")
