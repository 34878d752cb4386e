"""A sink: documents' blocks as word-processor files in a binary column."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumix.session import ship

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = (
    f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/>'
    '<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'
)
_RELS = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_DOC_RELS = (
    f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="s" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    '<Relationship Id="n" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/></Relationships>'
)
_STYLES = f"{_HEAD}<w:styles {_NS}>" + "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{40 - 4 * n}"/></w:rPr></w:style>' for n in range(1, 7)) + "</w:styles>"
_NUMBERING = (
    f"{_HEAD}<w:numbering {_NS}>" + "".join(f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl></w:abstractNum>' for i, f, t in ((0, "bullet", "•"), (1, "decimal", "%1.")))
    + "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (0, 1)) + "</w:numbering>"
)
_BAD = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


def _run(text: str) -> str:
    lines = _BAD.sub("", text).split("\n")
    return "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in lines) + "</w:r>"


def _paragraph(text: str, props: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{_run(text)}</w:p>"


def written(blocks: list[dict]) -> bytes:
    """A word-processor file of the blocks; equal blocks give equal bytes."""
    body = []
    for b in blocks:
        kind, text = b["type"], b.get("text") or ""
        if kind == "heading":
            body.append(_paragraph(text, f'<w:pStyle w:val="Heading{min(6, max(1, b.get("text_level") or 1))}"/>'))
        elif kind == "list":
            number = 2 if b.get("sub_type") == "ol" else 1
            body += [_paragraph(x, f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{number}"/></w:numPr>') for x in b.get("list_items") or ()]
        elif kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{_paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in b.get("table_rows") or ())
            body.append(f"<w:tbl><w:tblPr/>{rows}</w:tbl>")
        else:
            body.append(_paragraph(f"[{text or b.get('img_path', '')}]" if kind == "image" else text))
    document = f"{_HEAD}<w:document {_NS}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document), ("word/_rels/document.xml.rels", _DOC_RELS), ("word/styles.xml", _STYLES), ("word/numbering.xml", _NUMBERING)):
            z.writestr(zipfile.ZipInfo(name), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def to_word(documents: DataFrame, key: str = "doc_id", column: str = "blocks") -> DataFrame:
    """key and content (bytes) from blocks as JSON."""
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [written(json.loads(x or "[]")) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(files, pa.binary())], names=[key, "content"])

    return documents.select(key, column).mapInArrow(run, f"{key} {kind}, content binary")
